"""Operator 8: stupid-backoff language-model scores of documents, as joins.

Counts of all n-grams up to `order` over the whole corpus, then for each word w of a
document the score S(w | context): the count of context and w over that of the
context, if the former is at least `min_count`; else `backoff` times S with the
context's first word left out; for a single word its count over the corpus' words.
A document's score is the sum of the natural logarithms of S. Contexts do not reach
over the beginning of a document. Words are runs of anything but space and U+0009 to
U+000D.

As relations: documents are exploded into n-grams, the n-grams are counted in a
table that is partitioned by their hash, the table is joined to the exploded
n-grams, and the results are summed per document. A row of these relations holds a
sorted array: the distinct n-grams that a block of documents has in one bucket of
hashes. So an n-gram goes to its counting task once per block, however common it
is, and no key is hot; buckets grow in number with the corpus. A block's words stay
in a file of the shared folder until its counts return.

N-grams are told apart by 40 bits beside those of their bucket; as the number of
buckets follows the corpus, the chance that an n-gram shares them with another one
stays at about 10^-6.

Cases: a null or blank text has no words and score 0; a null doc_id is kept;
repeated rows are counted and scored each by itself; an empty table gives an empty
result; other columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import _arrow, texts_of, work_dir
from sessionloom.llm.mixing import words

BLOCK_WORDS = 1_200_000
CHARS_PER_BUCKET = 4_000_000
#: Of each hash, beside its bucket.
HASH_BYTES = 5
#: Odd numbers that mix hashes.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PARTS = "bucket long, block string, grams binary, counts binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX_A
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    return h ^ (h >> np.uint64(32))


def gram_hashes(ids: np.ndarray, word_hash: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n words that end at each place; 0 where the
    document begins less than n words before. `starts`: each word's document start."""
    own = word_hash[ids]
    out = [mixed(own)]
    place = np.arange(len(ids))
    for n in range(2, order + 1):
        # The n words that end here: the n - 1 that end one place before, and this one.
        longer = np.zeros_like(own)
        longer[1:] = mixed(out[n - 2][:-1] + np.uint64(n)) ^ own[1:]
        longer = mixed(longer)
        longer[place - starts < n - 1] = 0
        out.append(longer)
    return out


def _places(lengths: np.ndarray) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    return np.repeat(first, lengths)


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    every = every[every != 0]
    every.sort()
    new = np.append(True, every[1:] != every[:-1]) if len(every) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return every[at], np.diff(np.append(at, len(every))).astype(np.uint32)


def _planes(numbers: np.ndarray, kept: int) -> bytes:
    """The `kept` lowest bytes of each number, all first bytes first: of sorted or
    small numbers the higher ones compress well."""
    size = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, size)[:, :kept].T).tobytes()


def _numbers(planes: bytes, kept: int, size: int = 8) -> np.ndarray:
    out = np.zeros((len(planes) // kept, size), np.uint8)
    out[:, :kept] = np.frombuffer(planes, np.uint8).reshape(kept, -1).T
    return out.view(f"<u{size}").reshape(-1)


def _save(where: str, arrays: dict[str, np.ndarray], attempt: int) -> None:
    store, name = fs.FileSystem.from_uri(where)
    store.create_dir(name.rpartition("/")[0])
    table = pa.table({k: [v.tobytes()] for k, v in arrays.items()}, pa.schema([(k, pa.large_binary()) for k in arrays]))
    with store.open_output_stream(f"{name}.{attempt}") as out:
        with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
    store.move(f"{name}.{attempt}", name)


def _load(where: str, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    store, name = fs.FileSystem.from_uri(where)
    with store.open_input_file(name) as source:
        table = pa.ipc.open_file(source).read_all()
    return {k: np.frombuffer(table[k][0].as_buffer(), kind) for k, kind in kinds.items()}


FILE = {"doc_ids": np.int64, "null_ids": np.bool_, "lengths": np.int64, "ids": np.int32, "word_hash": np.uint64}


def _exploded(docs: DataFrame, folder: str, order: int, bits: int) -> DataFrame:
    """The distinct n-grams of each block and bucket with their counts there."""
    arrow = _arrow(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                split, total, hi = [], 0, lo
                while hi < len(texts) and (hi == lo or total < BLOCK_WORDS):
                    split.append(texts[hi].encode("utf-8", "surrogatepass").split())
                    total, hi = total + len(split[-1]), hi + 1
                numbers = _Numbers()
                ids = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int32, total)
                lengths = np.array([len(x) for x in split], np.int64)
                word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
                block = f"{task.partitionId():06d}-{count:06d}"
                _save(f"{folder}/{block}", {
                    "doc_ids": np.array([x or 0 for x in doc_ids[lo:hi]], np.int64), "null_ids": np.array([x is None for x in doc_ids[lo:hi]]),
                    "lengths": lengths, "ids": ids, "word_hash": word_hash}, task.taskAttemptId())
                grams, counts = _distinct(gram_hashes(ids, word_hash, _places(lengths), order))
                for bucket, a, b in _buckets(grams, bits):
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": [bucket], "block": [block], "grams": [_planes(_below(grams[a:b], bits), HASH_BYTES)], "counts": [_planes(counts[a:b], 4)]}, schema=arrow)
                if not total:  # a block without words returns too
                    yield pa.RecordBatch.from_pydict({"bucket": [0], "block": [block], "grams": [b""], "counts": [b""]}, schema=arrow)
                lo, count = hi, count + 1

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, PARTS)


def _below(grams: np.ndarray, bits: int) -> np.ndarray:
    """The HASH_BYTES bytes of each hash that follow its bucket, still sorted."""
    return grams << np.uint64(bits) >> np.uint64(64 - 8 * HASH_BYTES)


def _buckets(grams: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Bucket numbers and the part of the sorted `grams` that each holds."""
    if not len(grams):
        return
    bucket = grams >> np.uint64(64 - bits)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cut, [*cut[1:], len(grams)], strict=True):
        yield int(bucket[a]), a, b


RETURNED = "block string, bucket long, counts binary"


def scored(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, score (sum of ln S) and mean_score (per word; null without words)."""
    size = docs.agg(F.sum(F.char_length("text")).alias("chars"), F.sum(words(F.col("text"))).alias("words")).first()
    bits = min(24, max(3, math.ceil(math.log2(max(1, (size.chars or 0) / CHARS_PER_BUCKET)))))
    corpus, folder = float(size.words or 0), work_dir(docs.sparkSession, "lm-blocks")
    schema = "doc_id long, n_words long, score double, mean_score double"
    arrow, returned = _arrow(schema), _arrow(RETURNED)

    def count(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, counts = [], [], []
        for p in parts:
            names += p["block"].to_pylist()
            grams += [_numbers(g, HASH_BYTES) for g in p["grams"].to_pylist()]
            counts += [_numbers(c, 4, 4) for c in p["counts"].to_pylist()]
        sizes, every = [len(g) for g in grams], np.concatenate(grams)
        del grams
        found, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)[place]
        for name, part in zip(names, np.split(total, np.cumsum(sizes)[:-1]), strict=True):
            yield pa.RecordBatch.from_pydict({"block": [name], "bucket": [key[0].as_py()], "counts": [_planes(part, 8)]}, schema=returned)

    def score(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _load(f"{folder}/{key[0].as_py()}", FILE)
        rows = sorted((b, c) for p in parts for b, c in zip(p["bucket"].to_pylist(), p["counts"].to_pylist(), strict=True))
        lengths = block["lengths"]
        first = _places(lengths)
        hashes = gram_hashes(block["ids"], block["word_hash"], first, order)
        grams, _ = _distinct(hashes)
        counts = np.concatenate([_numbers(c, 8).view(np.int64) for _, c in rows])
        if len(counts) != len(grams):
            raise ValueError("a block's n-grams changed between its two reads")
        of = lambda h: counts[np.searchsorted(grams, h)] if len(grams) else np.empty(0, np.int64)
        value = before = None
        for n, h in enumerate(hashes, 1):
            there = h != 0
            c = np.zeros(len(h), np.int64)
            c[there] = of(h[there])
            if n == 1:
                value = np.log(np.maximum(c, 1) / max(corpus, 1.0))
            else:
                context = np.ones(len(h), np.int64)
                context[1:] = np.maximum(before[:-1], 1)
                seen = there & (c >= min_count)
                value = np.where(seen, np.log(np.maximum(c, 1) / context), value + np.where(there, math.log(backoff), 0.0))
            before = c
        doc = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(doc, weights=value, minlength=len(lengths))
        ids = [None if null else int(i) for i, null in zip(block["doc_ids"], block["null_ids"], strict=True)]
        mean = [float(t / n) if n else None for t, n in zip(total, lengths, strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": lengths.tolist(), "score": total.tolist(), "mean_score": mean}, schema=arrow)

    counted = _exploded(docs, folder, order, bits).groupBy("bucket").applyInArrow(count, RETURNED)
    return counted.groupBy("block").applyInArrow(score, schema)
