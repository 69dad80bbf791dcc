"""Operator 13 against plain sets of strings."""

import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import runs_index
from sessionloom.llm.queries import QUERIES
from tests.llm.helpers import TEXTS, documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, length):
    """The result rows of (doc_id, text), by the smallest document of every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p:p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p:p + length]] < i:
                    gone[p:p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g) and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(2, 9))
def test_index_finds_repeats_of_smaller_documents(texts, length):
    data = [t.encode() for t in texts]
    docs = np.arange(len(data)) // 2
    got = runs_index.repeats(data, docs, length)
    for n, text in enumerate(data):
        earlier = {d[p:p + length] for m, d in enumerate(data) if docs[m] < docs[n] for p in range(len(d) - length + 1)}
        assert got[n].tolist() == [p for p in range(len(text) - length + 1) if text[p:p + length] in earlier]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=90), min_size=1, max_size=5), st.sampled_from([7, 8, 20, 50]))
def test_every_string_has_its_own_anchor(texts, length):
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    at, h = runs_index.anchors(np.frombuffer("".join(texts).encode(), np.uint8), starts, ends, length)
    k, by_string = runs_index.anchor_width(length), {}
    for n, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            a = starts[n] + p
            inside = tuple((x - a, y) for x, y in zip(at.tolist(), h.tolist()) if a <= x <= a + length - k)
            least = min(y for _, y in inside)
            mine = tuple(x for x in inside if x[1] == least)
            assert mine and by_string.setdefault(text[p:p + length], mine) == mine


def repetitive(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passages = [" ".join(r.choices(words, k=r.randint(12, 60))) for _ in range(5)]
    texts = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(3)]
        if r.random() < 0.7:
            parts.insert(1, r.choice(passages))
        if r.random() < 0.5:
            parts.insert(0, passages[0])
        texts.append(" ".join(parts))
        if r.random() < 0.2:
            texts.append(r.choice(texts))
        if r.random() < 0.2:
            near = r.choice(texts)
            texts.append(near[: len(near) // 2] + "X" + near[len(near) // 2:])
    texts += ["-" * 700, "-" * 300, "ab" * 400, "x" * 49, "x" * 50, "x" * 51, None, "", "日本" * 200]
    return texts


@pytest.mark.parametrize("chunk", [runs_index.CHUNK, 3000])
def test_documents_equal_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(runs_index, "CHUNK", chunk)
    monkeypatch.setattr(runs_index, "SEGMENT", 200)
    monkeypatch.setattr(runs_index, "BLOCK_ROWS", 13)
    monkeypatch.setattr(runs_index, "PIECE", 500)
    rows = [(i * 7 % 311 if i % 29 else None, t) for i, t in enumerate(repetitive(3, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS block", "1 AS place", "2 AS start").repartition(5)
    assert found(runs_index.deduplicated(df)) == plain(rows, 50)


def test_what_is_sent_to_buckets_follows_the_texts(spark, tmp_path, monkeypatch):
    """Anchors take seven bytes each, however many buckets a block's are dealt to."""
    texts = [" ".join(f"{i}x{k}" for k in range(60)) for i in range(40)]
    ids = list(range(40))
    keys = runs_index._Keys(ids, [t.encode() for t in texts], set(), 1000, 50)
    runs_index._write_blocks(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1), f"file://{tmp_path}", 50).count()
    seen = []
    blocks = spark.createDataFrame([(0, [])], "block long, copies array<int>").coalesce(1)
    plain_map = type(blocks).mapInArrow
    monkeypatch.setattr(type(blocks), "mapInArrow", lambda self, f, shape: seen.append(plain_map(self, f, shape)) or seen[-1])
    runs_index._shared(blocks, f"file://{tmp_path}", 1000, 50)
    size = sum(len(v) for r in seen[0].collect() for v in r if isinstance(v, (bytes, bytearray)))
    assert size == 7 * len(keys.key)


def test_documents_of_all_kinds(spark):
    docs = documents(spark)
    assert found(runs_index.deduplicated(docs)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    assert found(runs_index.deduplicated(documents(spark, TEXTS[:0]))) == []


def test_query_equals_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found(QUERIES["op13_runs_index"](spark, SF)) == plain([tuple(r) for r in docs], 50)


def test_remaining_text(spark):
    passage = "the same long passage stands in both of these documents, word for word "
    df = spark.createDataFrame([(1, "one " + passage), (2, passage + "two")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in runs_index.deduplicated(df, texts=True).collect()}
    assert kept == {1: ("one " + passage).encode(), 2: b"two"}
