"""Operator 10: repetition inside a text by suffix arrays.

Words (runs of anything but space and U+0009 to U+000D) of a block of texts are
numbered, and the suffixes of all its texts are sorted together by prefix
doubling: after step k a suffix is ranked by its first 2^k words, and only suffixes
that still share a rank are sorted again. The text's number leads each key and a
text's end ranks below every word, so repeats are found inside one text only. The
ranks kept for each step give the longest common prefix (LCP) of neighbours in
suffix order by descending over the steps. LCP intervals of height `min_words` or
more are the maximal repeated substrings; every suffix in one covers as many words
as the larger of its two neighbouring LCPs, and the union of these spans is the
covered part. The longest repeat is the largest LCP.

A text is kept if it has at least `min_total` words, at most `max_covered` of its
words are covered by repeats of `min_words` words or more, and its longest repeat
is neither over `max_longest` words nor over that share of the text.

Cases: a null or blank text has no words and is rejected; repeated rows are judged
each by itself; an empty table gives an empty result; a text of any length is
handled whole (a block holds one text at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm.common import map_batches, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, longest_repeat long, kept boolean"
)
#: Words sorted together; bounds the memory of a task.
BLOCK_WORDS = 600_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of `key`, its dense ranks, and whether a rank is shared."""
    order = np.argsort(key, kind="stable")
    there = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(there[1:], there[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    alone = new & np.append(new[1:], True)
    shared = np.empty(len(key), bool)
    shared[order] = ~alone
    return order, rank, shared


def suffix_order(ids: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the words `ids` of several texts, and the ranks by the
    first 1, 2, 4, ... words."""
    n = len(ids)
    _, rank, shared = _ranks(text_of.astype(np.int64) << 36 | ids)
    # A text's last word and the other texts' words never share a rank, as a rank tells the text.
    end = np.searchsorted(text_of, text_of, side="right")
    # Ranks count the smaller suffixes, so that refined ones stay in order.
    count = np.bincount(rank)
    rank = (np.cumsum(count) - count)[rank]
    levels, step = [rank], 1
    while shared.any():
        at = np.flatnonzero(shared)
        follow = at + step
        tail = np.where(follow < end[at], rank[np.minimum(follow, n - 1)] + 1, 0)
        # The key sorts inside each shared rank; its place there refines the rank.
        order, sub, again = _ranks(rank[at] * (n + 2) + tail)
        group = rank[at][order]
        first = np.searchsorted(group, group, side="left")
        low = sub[order]
        lead = np.searchsorted(low, low, side="left")
        rank = rank.copy()
        rank[at[order]] = group + lead - first
        levels.append(rank)
        shared = np.zeros(n, bool)
        shared[at] = again
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], text_of: np.ndarray) -> np.ndarray:
    """Words that each suffix in `order` shares with the one before it."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    end = np.searchsorted(text_of, text_of, side="right")
    live = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[live - 1].copy(), order[live].copy()
    found, stop_a, stop_b = np.zeros(len(live), np.int64), end[a], end[b]
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = (a < stop_a) & (b < stop_b)
        same = inside.copy()
        same[inside] = rank[a[inside]] == rank[b[inside]]
        # Equal ranks of 2^k words that reach past the end would mean equal suffixes.
        found[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[live] = found
    return lcp


def repeats(ids: np.ndarray, lengths: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts that lie one after the other in `ids`: words covered by repeats
    of at least `min_words` words, and the longest repeat."""
    texts = len(lengths)
    text_of = np.repeat(np.arange(texts), lengths)
    if not len(ids):
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    order, levels = suffix_order(ids, text_of)
    lcp = neighbour_lcp(order, levels, text_of)
    reach = np.zeros(len(ids), np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text_of, reach)
    start = np.flatnonzero(reach >= min_words)
    delta = np.zeros(len(ids) + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + reach[start], -1)
    covered = np.bincount(text_of, weights=np.cumsum(delta[:-1]) > 0, minlength=texts)
    return covered.astype(np.int64), longest


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return len(lines) - len(set(lines))


def _judge(texts: list[str | None], limits: dict[str, int]) -> Iterator[dict[str, list]]:
    """The figures of SCHEMA for each text, block by block."""
    limit = {"min_total": 10, "min_words": 5, "max_covered": 20, "max_longest": 200, "max_longest_percent": 15} | limits
    lo = 0
    while lo < len(texts):
        numbers, parts, total, hi = _Numbers(), [], 0, lo
        while hi < len(texts) and (hi == lo or total < BLOCK_WORDS):
            words = (texts[hi] or "").encode("utf-8", "surrogatepass").split()
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            total, hi = total + len(words), hi + 1
        yield _block([t or "" for t in texts[lo:hi]], parts, limit)
        lo = hi


def _block(texts: list[str], parts: list[np.ndarray], limit: dict[str, int]) -> dict[str, list]:
    sizes = np.array([len(p) for p in parts], np.int64)
    covered, longest = repeats(np.concatenate(parts), sizes, limit["min_words"])
    failed = (sizes < limit["min_total"]) | (100 * covered > limit["max_covered"] * sizes)
    kept = ~failed & (longest <= limit["max_longest"])
    kept &= 100 * longest <= limit["max_longest_percent"] * sizes + 100 * limit["min_words"]
    return {
        "n_words": sizes.tolist(), "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": [dup_lines(t) for t in texts],
        "n_repeat_words": covered.tolist(), "base_failed": failed.tolist(), "longest_repeat": longest.tolist(), "kept": kept.tolist(),
    }


def judged(docs: DataFrame, keep: list[str], **limits: int) -> DataFrame:
    """The columns `keep` of each row and the figures of SCHEMA for its text.
    limits: min_total, min_words, max_covered (percent), max_longest (words),
    max_longest_percent."""
    kinds, kept_as = dict(docs.dtypes), [f"__k{i}" for i, _ in enumerate(keep)]

    def step(cols: dict[str, list]):
        lo = 0
        for found in _judge(cols["__text"], limits):
            hi = lo + len(found["kept"])
            yield {c: cols[c][lo:hi] for c in kept_as} | found
            lo = hi

    columns = [docs[c].alias(k) for k, c in zip(kept_as, keep, strict=True)]
    schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in zip(kept_as, keep, strict=True)), SCHEMA])
    out = map_batches(docs.select(*columns, docs["text"].alias("__text")), schema, step)
    return out.withColumnsRenamed(dict(zip(kept_as, keep, strict=True)))


def passing(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [k for found in _judge(batch.column(at).to_pylist(), limits) for k in found["kept"]]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
