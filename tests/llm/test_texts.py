"""Operators 1, 4, 6, 8 and 10 against plain versions, on cases of all kinds."""

import hashlib
import io
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import lm_backoff, pii_crf, records, suffix_repeats, trie_pieces
from sessionloom.llm.common import work_dir
from tests.llm.helpers import LONG, TEXTS, documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_records(spark, tokenizer):
    out = work_dir(spark, "test-records")
    docs = documents(spark)
    index = records.write_records(docs, out, BPE, 2)
    got = sorted(records.read_records(spark, out).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for x in random.Random(1).sample(index.collect(), 5):
        doc_id, ids = records.fetch(out, x.shard, x.offset, x.length)
        assert (doc_id, len(ids)) == (x.doc_id, x.n_tokens)


def test_records_of_an_empty_table(spark):
    out = work_dir(spark, "test-records")
    records.write_records(documents(spark).limit(0), out, BPE, 2)
    assert records.read_records(spark, out).collect() == []


def test_damaged_record():
    good = records.frame(records.pack(7, b"\1\0\2\0", False))
    (at, payload), = records.records_of(io.BytesIO(good))
    doc_id, ids = records.unpack(payload)
    assert (at, doc_id, ids.tolist()) == (0, 7, [1, 2])
    for i in range(len(good)):
        with pytest.raises(ValueError):
            list(records.records_of(io.BytesIO(good[:i] + bytes([good[i] ^ 1]) + good[i + 1:])))


PARTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "'s", "12", "!", "é", "<|", "日本"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_word_by_word_ids(tokenizer, text):
    assert np.frombuffer(records.encode_texts([text], BPE)[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_with_inner_white_space_share_a_call(tokenizer, monkeypatch):
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    _, _, width, sizes = records._tokenizer(BPE)
    monkeypatch.setitem(records._tokenizers, BPE, (Counted(), {}, width, sizes))
    text = "a " + " ".join(f"end{i}.\nStart{i}" for i in range(300))
    assert np.frombuffer(records.encode_texts([text], BPE)[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(calls) < 10


def plain_repeats(w, least):
    n, cover, longest = len(w), set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                cover.update(range(i, i + k))
    return len(cover), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5), st.integers(1, 5))
def test_suffix_array(texts, least):
    ids = np.array([x for t in texts for x in t], np.int64)
    covered, longest = suffix_repeats.repeats(ids, np.array([len(t) for t in texts]), least)
    assert list(zip(covered.tolist(), longest.tolist(), strict=True)) == [plain_repeats(t, least) for t in texts]


def test_repetition_rules(spark, monkeypatch):
    texts = [*TEXTS, "alpha beta gamma delta epsilon zeta " * 6, " ".join(f"u{i}" for i in range(400)), "# $ | < > & x\n# $ | < > & x"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in suffix_repeats.judged(docs, ["doc_id"]).collect()}
    for doc_id, text in enumerate(texts):
        r, text = got[None if doc_id == 5 else doc_id], text or ""
        w = WORDS.findall(text)
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert got[13].kept and not got[12].kept
    passed = suffix_repeats.passing(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == {i for i, r in got.items() if r.kept}
    assert suffix_repeats.judged(docs.limit(0), ["doc_id"]).collect() == []


def test_a_word_of_any_length_takes_little_memory():
    import tracemalloc

    import sentencepiece

    word = "".join(random.Random(3).choices("abcdeXYZ019+/=日本語ß🙂", k=200_000))
    model = trie_pieces.Model(PIECES)
    tracemalloc.start()
    try:
        short, = model.encode([word[:3000]])
        base = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        got, = model.encode([word])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert np.frombuffer(short, "<u2").tolist() == library.encode(word[:3000])
    assert np.frombuffer(got, "<u2").tolist() == library.encode(word)
    assert most < 400e6 and base < 40e6


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark)
    got = trie_pieces.round_trip(docs, PIECES).collect()
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        text = by_id[r.doc_id]
        assert r.ids == library.encode(text) and r.n_ids == len(r.ids)
        assert r.text_sha256 == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    back = trie_pieces.decode(trie_pieces.encode(docs, PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == {k: v.replace("▁", " ") for k, v in by_id.items()}
    assert trie_pieces.encode(docs.limit(0), PIECES).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "    ", "\n", "tion", "é", "日", "\x00", "🙂", ".", "1"]), max_size=20).map("".join))
def test_pieces_of_any_text(text):
    import sentencepiece

    model = trie_pieces._model(PIECES)
    ids = np.frombuffer(model.encode([text])[0], "<u2").tolist()
    assert ids == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert model.decode(ids) == text


@pytest.mark.parametrize(("order", "least"), [(3, 2), (2, 1)])
def test_backoff_scores(spark, monkeypatch, order, least):
    docs = documents(spark)
    rows = [(r.doc_id, WORDS.findall(r.text or "")) for r in docs.collect()]
    counts = Counter(tuple(w[i:i + n]) for _, w in rows for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in rows)

    def s(g):
        if len(g) == 1:
            return counts[g] / total
        return counts[g] / counts[g[:-1]] if counts[g] >= least else 0.4 * s(g[1:])

    want = sorted((str(d), len(w), round(sum(math.log(s(tuple(w[max(0, i - order + 1):i + 1]))) for i in range(len(w))), 5)) for d, w in rows)
    got = lm_backoff.scored(docs, order, 0.4, least).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.score, 5)) for r in got) == want
    assert all((r.mean_score is None) == (r.n_words == 0) for r in got)
    assert lm_backoff.scored(docs.limit(0)).collect() == []


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and pii_crf.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if ok else []
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", ".", "x-y", "1", "4539578763621486", "10.0.255.1", "256", " ", "-", "+", "(", ")", "é", "00", "com"]), max_size=12).map("".join))
def test_base_patterns(text):
    assert pii_crf.base_spans(text) == plain_base(text)


def test_field_on_held_out_sentences():
    field = pii_crf.trained()
    hit = extra = lost = 0
    for text, spans in pii_crf.examples(300, seed=77):
        got = set(pii_crf.added_spans(text, field, []))
        hit, extra, lost = hit + len(got & set(spans)), extra + len(got - set(spans)), lost + len(set(spans) - got)
    assert hit / (hit + extra) > 0.97 and hit / (hit + lost) > 0.97
    assert pii_crf.added_spans("On 2024-05-06 at 10:30 we sold 1,250 units of v2.3 for $12.50, see page 14.", field, []) == []


def test_best_path_is_the_best_of_all():
    field = pii_crf.trained()
    lattice = pii_crf.Lattice("call 212-555-0142 now", 0, 21)
    segments = field.numbered(lattice)
    n = len(lattice)

    def paths(at):
        if at == n:
            return [[]]
        found = [[(at, at + 1, -1, 0.0), *p] for p in paths(at + 1)]
        for j in range(at + 1, n + 1):
            for i, f in segments[j]:
                if i == at:
                    for y, w in enumerate(field.w[f].sum(0)):
                        found += [[(i, j, y, w), *p] for p in paths(j)]
        return found

    def value(path):
        types = [0, *[y + 1 for _, _, y, _ in path]]
        return sum(w for *_, w in path) + sum(field.next[a, b] for a, b in zip(types, types[1:], strict=False))

    best = max(paths(0), key=value)
    assert field.best(lattice) == [(i, j, y) for i, j, y, _ in best if y >= 0]


@pytest.mark.parametrize("line", ["1234567 ", "10.1.2.3\n", "a.b@c.example.com\n"])
def test_long_texts_of_numbers_and_addresses(line):
    field, text = pii_crf.trained(), line * 4000
    base = pii_crf.base_spans(text)
    pii_crf.added_spans(text[:8000], field, [])
    began = time.process_time()
    tracemalloc.start()
    pii_crf.added_spans(text, field, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - began < 60 and peak < 60_000_000


def test_personal_data(spark):
    secret = "9f3c" * 10
    texts = [*TEXTS, f"mail a.b@c.example.com, ip 10.1.2.3 card 4539578763621486 or +1 (743) 555-3824; token = \"{secret}\"", LONG + " x@y.org " + LONG]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in pii_crf.spans_of(docs).collect()}
    for i, text in enumerate(texts):
        r, base = got[None if i == 5 else i], plain_base(text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert f"secret:{texts[12].index(secret)}:" in got[12].spans and got[13].spans == f"email:{len(LONG) + 1}:{len(LONG) + 8}"
    clean = {r.doc_id: r for r in pii_crf.redacted(docs).collect()}
    assert clean[12].text == 'mail [EMAIL], ip [IP] card [CARD] or [PHONE]; token = "[SECRET]"' and clean[12].n_chars == len(clean[12].text)
    assert clean[0].text is None and clean[4].text == texts[4] and pii_crf.redacted(docs).columns == docs.columns
    assert pii_crf.spans_of(docs.limit(0)).collect() == []
