"""Operator 12: ranked lexical search by dense blocked matrix products.

Items (the queries) are dealt to tiles of bounded size, each with a compact
vocabulary of its own: the distinct terms of its items. Tiles are rows of a table in
the shared work folder. A task reads documents slice by slice, counts the terms of a
tile's vocabulary and multiplies, vocabulary block by vocabulary block, the items'
weights with the documents' impacts in float64. Weights and impacts are integers;
a block has so few terms that no partial sum reaches 2^53, so every product is exact,
and blocks are added as 64-bit integers. Of each slice a task keeps, per item, all
scores that reach its `top`-th best (ties included) and cuts only by (score, doc_id).
Tasks' lists are merged per item in two steps.

A term is a maximal run of letters and digits of ASCII or of any characters beyond
ASCII; only A-Z are lower-cased. With N documents with a term, L terms in all, n terms
in a document, df and tf as usual: weight floor(1000 ln((2N+2)/(2df+1))), m =
10 + (90 n N) div L, impact (10^9 tf) div (1000 tf + 8 m); the score is the sum of
weight x impact over an item's distinct terms.

Cases: a null or empty text has no term and is never found; an item without terms
gives no row; rows with one item_id are one item with the terms of all; repeated
documents are ranked each by itself; equal scores by ascending doc_id, a null doc_id
last; empty tables give an empty result; texts of any length are read whole; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import _arrow, map_batches, materialize, work_dir

#: Item-term pairs and items of a tile, terms of a vocabulary block, rows and characters of a slice.
TILE_PAIRS, TILE_ITEMS, BLOCK_TERMS, SLICE_ROWS, SLICE_CHARS = 8192, 256, 2048, 512, 4_000_000
EXACT = 1 << 53
#: Parts of an item's candidates that are cut to the best before they meet.
SALTS = 64
#: ASCII bytes that are no letter or digit become spaces, A-Z become a-z.
CLASSES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(CLASSES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, one a row."""

    def step(cols: dict[str, list]):
        for item, text in zip(cols["item_id"], cols["text"], strict=True):
            found = sorted(set(terms_of(text)))
            yield {"item_id": [item] * len(found), "term": found}

    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_batches(given, "item_id long, term binary", step).distinct()


class Tile:
    """Vocabulary, items and, once known, weights of one tile."""

    def __init__(self, folder: str, number: int):
        pairs = _rows(folder, number)
        terms = sorted(set(pairs["term"].to_pylist()))
        self.terms, self.place = terms, {t: i for i, t in enumerate(terms)}
        ids = pairs["item_id"].to_pylist()
        self.items = sorted(set(ids), key=lambda x: (x is not None, x or 0))
        at = {x: i for i, x in enumerate(self.items)}
        self.row = np.array([at[x] for x in ids], np.int64)
        self.col = np.array([self.place[t] for t in pairs["term"].to_pylist()], np.int64)
        self.weights: list[tuple[int, int, np.ndarray]] = []

    def weigh(self, folder: str, number: int, documents: int) -> Tile:
        """Dense weights in vocabulary blocks (first term, end, items x terms)."""
        found, weight = _rows(folder, number), np.zeros(len(self.terms))
        for term, df in zip(found["term"].to_pylist(), found["df"].to_pylist(), strict=True):
            weight[self.place[term]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        most = max(1, int(weight.max(initial=0))) * 1_000_000  # an impact is below 10^6
        width = max(1, min(BLOCK_TERMS, (EXACT - 1) // most))
        for lo in range(0, len(weight), width):
            hi = min(lo + width, len(weight))
            inside = (self.col >= lo) & (self.col < hi)
            dense = np.zeros((len(self.items), hi - lo))
            dense[self.row[inside], self.col[inside] - lo] = weight[self.col[inside]]
            self.weights.append((lo, hi, dense))
        return self


def _rows(folder: str, number: int) -> pa.Table:
    store, path = fs.FileSystem.from_uri(f"{folder}/tile={number}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return pa.table({"term": pa.array([], pa.binary()), "df": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64())})
    return ds.dataset(path, filesystem=store, format="parquet").to_table()


@functools.lru_cache(maxsize=4)
def _tile(folder: str, number: int) -> Tile:
    return Tile(folder, number)


@functools.lru_cache(maxsize=4)
def _weighed(folder: str, dfs: str, number: int, documents: int) -> Tile:
    return Tile(folder, number).weigh(dfs, number, documents)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """doc_ids and terms of some documents at a time, bounded in rows and characters."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and hi - lo < SLICE_ROWS and (hi == lo or chars + len(texts[hi] or "") <= SLICE_CHARS):
                chars, hi = chars + len(texts[hi] or ""), hi + 1
            yield ids[lo:hi], [terms_of(t) for t in texts[lo:hi]]
            lo = hi


def _counts(docs: list[list[bytes]], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of each term of the vocabulary in each document."""
    width = max(1, len(place))
    known = [[place[t] for t in terms if t in place] for terms in docs]
    sizes = [len(k) for k in known]
    flat = np.fromiter((x for k in known for x in k), np.int64, sum(sizes))
    pairs, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) * width + flat, return_counts=True)
    return pairs // width, pairs % width, tf


def _scores(tile: Tile, found: tuple[np.ndarray, np.ndarray, np.ndarray], m: np.ndarray) -> np.ndarray:
    """Items x documents, exact."""
    doc, term, tf = found
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    out = np.zeros((len(tile.items), len(m)), np.int64)
    for lo, hi, dense in tile.weights:
        inside = (term >= lo) & (term < hi)
        if inside.any():
            block = np.zeros((len(m), hi - lo))
            block[doc[inside], term[inside] - lo] = impact[inside]
            out += (dense @ block.T).astype(np.int64)
    return out


class Best:
    """The best (score, doc_id) of each item of a tile so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.held = np.zeros((4, 0), np.int64)  # item, -score, whether doc_id is null, doc_id

    def add(self, scores: np.ndarray, ids: list) -> None:
        reach = self.floor
        if scores.shape[1] > self.top:
            kth = np.partition(scores, scores.shape[1] - self.top, axis=1)[:, scores.shape[1] - self.top]
            reach = np.maximum(reach, kth)
        item, doc = np.nonzero(scores >= reach[:, None])
        if not len(item):
            return
        null = np.array([i is None for i in ids], np.int64)
        known = np.array([i or 0 for i in ids], np.int64)
        held = np.concatenate([self.held, np.stack([item, -scores[item, doc], null[doc], known[doc]])], axis=1)
        held = held[:, np.lexsort(held[::-1])]
        place = np.arange(held.shape[1]) - np.searchsorted(held[0], held[0])
        self.held = held[:, place < self.top]
        last = place == self.top - 1
        self.floor[held[0][last]] = -held[1][last]


def ranked(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each item. docs:
    doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = materialize(item_terms(items), "item-terms")
    size = pairs.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("item_id", F.lit(-1))).alias("items")).first()
    tiles = max(1, -(-size["n"] // TILE_PAIRS), -(-size["items"] // TILE_ITEMS))
    dealt = pairs.withColumn("tile", F.pmod(F.xxhash64("item_id"), F.lit(tiles)).cast("int"))
    folder, dfs = work_dir(spark, "rank-tiles"), work_dir(spark, "rank-df")
    dealt.repartition("tile").write.partitionBy("tile").parquet(folder)

    shape = "tile int, term binary, df long, n_docs long, n_terms long"
    tally = _arrow(shape)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_seen = terms_seen = 0
        for _, texts in _slices(batches):
            docs_seen, terms_seen = docs_seen + sum(map(bool, texts)), terms_seen + sum(map(len, texts))
            for number in range(tiles):
                tile = _tile(folder, number)
                df = np.bincount(_counts(texts, tile.place)[1], minlength=len(tile.terms))
                seen = np.flatnonzero(df).tolist()
                none = [None] * len(seen)
                yield pa.RecordBatch.from_pydict({
                    "tile": [number] * len(seen), "term": [tile.terms[i] for i in seen], "df": df[seen].tolist(),
                    "n_docs": none, "n_terms": none}, schema=tally)
        yield pa.RecordBatch.from_pydict(
            {"tile": [-1], "term": [None], "df": [None], "n_docs": [docs_seen], "n_terms": [terms_seen]}, schema=tally)

    counted = given.mapInArrow(count, shape)
    sums = counted.groupBy("tile", "term").agg(*[F.sum(c).alias(c) for c in ("df", "n_docs", "n_terms")])
    sums.repartition("tile").write.partitionBy("tile").parquet(dfs)
    whole = spark.read.schema(shape).parquet(dfs).where("tile = -1").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = whole[0] or 0, whole[1] or 0

    best = _arrow("item_id long, doc_id long, score long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}
        for ids, texts in _slices(batches):
            m = np.array([10 + 90 * len(t) * n_docs // max(n_terms, 1) for t in texts], np.int64)
            for number in range(tiles):
                tile = _weighed(folder, dfs, number, n_docs)
                found = _counts(texts, tile.place)
                if len(found[0]):
                    kept.setdefault(number, Best(len(tile.items), top)).add(_scores(tile, found, m), ids)
        for number, one in kept.items():
            names, held = _tile(folder, number).items, one.held.tolist()
            yield pa.RecordBatch.from_pydict({
                "item_id": [names[i] for i in held[0]], "score": [-s for s in held[1]],
                "doc_id": [None if null else d for null, d in zip(held[2], held[3], strict=True)]}, schema=best)

    found = given.mapInArrow(score, "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = Window.partitionBy("item_id", "__salt").orderBy(*order)
    last = Window.partitionBy("item_id").orderBy(*order)
    few = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= top)
    out = few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")
