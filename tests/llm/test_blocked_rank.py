"""Operator 12 against a plain loop over all documents."""

import math
import random
import re

import pytest

from sessionloom.llm import blocked_rank
from tests.llm.helpers import TEXTS, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scores = []
        for i, t in found:
            m = 10 + 90 * len(t) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m))
                    for x in words if x in t)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, top=10):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS item_id", "2 AS tile").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS doc_id")
    got = [tuple(r) for r in blocked_rank.ranked(a, b, top).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == plain(docs, items, top)


@pytest.mark.parametrize("tile, block, rows", [(8192, 2048, 512), (40, 7, 5)])
def test_rank_equals_plain_loop(spark, monkeypatch, tile, block, rows):
    monkeypatch.setattr(blocked_rank, "TILE_PAIRS", tile)
    monkeypatch.setattr(blocked_rank, "BLOCK_TERMS", block)
    monkeypatch.setattr(blocked_rank, "SLICE_ROWS", rows)
    r = random.Random(tile)
    words = ["w%d" % (i * i % 97) for i in range(60)] + ["Größe", "ÑU", "日本", "a-b", "X"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(150)]
    docs += [(400 - i, "tie tie tie here") for i in range(30)] + docs[:5] + [(None, "tie tie tie here"), (7, None), (8, "  .,; ")]
    items = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(25)]
    items += [(90, "tie"), (90, "w4 tie"), (91, "tie TIE tie"), (None, "w1 here"), (92, None), (93, "absent"), (94, " ".join(words))]
    check(spark, docs, items)


def test_rank_of_all_kinds_and_empty_tables(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    check(spark, docs, [(1, "to be same text W5X5"), (2, TEXTS[-1])], top=3)
    check(spark, docs, [])
    check(spark, [], [(1, "some words")])
