"""Operator 13: removal of long passages that repeat, by run-length indexes.

A byte goes if a string of `length` bytes that covers it also starts in a document with
a smaller doc_id. Texts are UTF-8 bytes; matches never cross documents.

1. Documents are written as blocks, ascending by doc_id within. Whole copies (equal
   digests) are known from an aggregate and go by themselves.
2. Every string of `length` bytes has an anchor, its k-byte substring of least hash, so
   that equal strings have equal anchors. A block's distinct anchors are dealt to buckets
   by hash, as arrays. A bucket knows for each anchor the first document (by block and
   place) that has it and returns those that two documents share.
3. The bytes around shared anchors of one first document form regions; these are dealt
   by that document (the family), so that all strings that may be equal meet. A family
   beyond CHUNK bytes is dealt to several chunks by doc_id.
4. A task sorts the suffixes of a shard's regions, keeps of their Burrows-Wheeler
   transform one sample per run (position at the run's start, the one at the end of the
   run before, their common prefix) and drops the rest. Streaming the regions over these
   samples gives for every position its matching statistics: where the neighbouring
   occurrence starts and how long it matches. Chains of neighbours that match `length`
   bytes or more are the occurrences of one string; all beyond its smallest document are marked.
5. Strings of a divided family that are new in their chunk meet once more: their 128-bit
   hashes are dealt to buckets, as arrays (each chunk gives one document for a string).
6. Marks return to their blocks; spans are united, texts cut and digested.

Anchors only select: what is marked inside a chunk has been compared byte by byte, what
is marked between chunks by 128 bits.

Cases: a null text is empty; texts shorter than `length` stay whole; a null doc_id
compares with none: its text stays whole and removes nothing; rows with one doc_id do
not remove each other's bytes; an empty table gives an empty result; texts of any length
are read whole, in overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import _arrow, materialize, texts_of, work_dir

LENGTH = 50
#: Bytes and rows of a block of documents, bytes of a piece of one text.
BLOCK_BYTES, BLOCK_ROWS, PIECE = 2_000_000, 4096, 1 << 20
#: Anchors of a bucket, bytes of a shard and of a family's chunk, longest string that is sorted.
BUCKET, SHARD, CHUNK, SEGMENT = 1_500_000, 2_000_000, 1_000_000, 512
#: Bytes of an anchor's hash that tell it from others of its bucket; those that agree in
#: them count as one, which selects a little more than needed.
KEY_BYTES = 5
#: No UTF-8 text holds this byte.
STOP = 0xFF
MULTIPLIER, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def string_hashes(data: np.ndarray, width: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """A hash of each `width` bytes of `data`, put together from hashes of doubled widths."""
    base = _mixed(np.arange(1, 257, dtype=np.uint64) * multiplier)
    level, size, out, done, factor = base[data], 1, None, 0, multiplier
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if out is None:
                    out, done = level, size
                else:
                    n = min(len(level), max(0, len(out) - size))
                    out, done = level[:n] * np.uint64(pow(int(multiplier), done, 1 << 64)) + out[size:size + n], done + size
            if size * 2 > width:
                return _mixed(out) | np.uint64(1)
            n = max(0, len(level) - size)
            level = level[:n] * factor + level[size:]
            factor, size = factor * factor, size * 2


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchor_width(length: int) -> int:
    """Bytes of an anchor: long enough that unlike texts seldom share one."""
    return max(1, 2 * length // 3 - 1)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of `length` bytes inside the
    texts data[start:end]. Among equal hashes of one string all are anchors."""
    k = anchor_width(length)
    w = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = string_hashes(data, k)
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(len(data) + 2, np.int32)
    full = ends - starts >= length
    np.add.at(edge, starts[full], 1)
    np.add.at(edge, ends[full] - length + 1, -1)
    least[np.cumsum(edge[:len(least)]) <= 0] = 0
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1:w - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return at, h[at]


def _block_anchors(ids: list, texts: list[bytes], skip: set[int], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, position in the text and hash of the anchors of a block, some pieces at a time."""
    parts, places, bases, size = [], [], [], 0
    for place, text in enumerate(texts):
        if place in skip or ids[place] is None or len(text) < length:
            continue
        for lo in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[lo:lo + PIECE + length - 1]
            parts.append(part)
            places.append(place)
            bases.append(lo)
            size += len(part)
            if size >= PIECE:
                yield _parts_anchors(parts, places, bases, length)
                parts, places, bases, size = [], [], [], 0
    if parts:
        yield _parts_anchors(parts, places, bases, length)


def _parts_anchors(parts: list[bytes], places: list[int], bases: list[int], length: int):
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    at, h = anchors(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends, length)
    part = np.searchsorted(ends, at, side="right")
    return np.array(places, np.int64)[part], np.array(bases, np.int64)[part] + at - (ends - sizes)[part], h


def suffix_array(data: np.ndarray, to_stop: np.ndarray) -> np.ndarray:
    """Order of the suffixes of texts that each end in STOP, by prefix doubling. to_stop:
    bytes before the text's end. Equal suffixes are in order of position."""
    n = len(data)
    key = _words(data, to_stop)
    order, rank, shared = _ranked(key)
    del key
    step = 8
    while True:
        # A suffix that ends within `step` bytes is settled.
        at = np.flatnonzero(shared & (to_stop >= step))
        if not len(at):
            return np.argsort(rank, kind="stable")
        sub_order, sub, again = _ranked(rank[at] * n + rank[at + step])
        ordered = at[sub_order]
        group, place = rank[ordered], sub[sub_order]
        rank[ordered] = group + (place - place[np.searchsorted(group, group, side="left")])
        shared[:] = False
        shared[at] = again
        step *= 2


def _words(data: np.ndarray, to_stop: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; those after a STOP count as STOP."""
    padded = np.concatenate([data, np.full(8, STOP, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i:i + len(data)]
    beyond = (8 * np.maximum(0, 8 - to_stop)).astype(np.uint64)
    mask = np.where(beyond >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(beyond, np.uint64(63))) - np.uint64(1))
    return key | mask


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, rank (number of smaller keys) and whether another has the same key."""
    order = np.argsort(key, kind="stable")
    there = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(there[1:], there[:-1], out=new[1:])
    rank, shared = np.empty(len(key), np.int64), np.empty(len(key), bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    shared[order] = ~(new & np.append(new[1:], True))
    return order, rank, shared


class RunIndex:
    """Samples at the run starts of the Burrows-Wheeler transform of texts that each end
    in STOP: their position, the position before them in suffix order (the end of the
    run before) and the prefix these two share."""

    def __init__(self, data: np.ndarray, to_stop: np.ndarray):
        order = suffix_array(data, to_stop)
        before = data[order - 1]
        # Each STOP is a letter of its own.
        start = np.ones(len(order), bool)
        start[1:] = (before[1:] != before[:-1]) | (before[1:] == STOP)
        rows = np.flatnonzero(start)
        at, previous = order[rows], order[np.maximum(rows - 1, 0)]
        shared = _common(data, to_stop, at, previous)
        shared[rows == 0] = 0
        by_place = np.argsort(at, kind="stable")
        self.at, self.previous, self.shared, self.size = at[by_place], previous[by_place], shared[by_place], len(data)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of every position: the neighbouring occurrence, and the
        bytes it shares. Within a run both move on with the position."""
        first = np.zeros(self.size, np.int64)
        first[self.at] = 1
        sample = np.cumsum(first) - 1
        moved = np.arange(self.size) - self.at[sample]
        return self.previous[sample] + moved, self.shared[sample] - moved


def _common(data: np.ndarray, to_stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and at b share."""
    most = np.minimum(to_stop[a], to_stop[b])
    out, live, done = most.copy(), np.flatnonzero(most > 0), 0
    padded = np.concatenate([data, np.full(8, STOP, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        unlike = words[a[live] + done] != words[b[live] + done]
        some = unlike.any(axis=1)
        hit = live[some]
        out[hit] = np.minimum(out[hit], done + unlike[some].argmax(axis=1))
        done += 8
        live = live[~some & (most[live] > done)]
    return out


def repeats(texts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For texts in ascending order of their documents: where strings of `length` bytes
    start that also start in a text of a smaller document."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    to_stop = ends[text_of] - 1 - np.arange(len(data))
    near, same = RunIndex(data, to_stop).stream()
    here = np.arange(len(data))
    root = np.where(same >= length, near, here)
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    first = np.full(len(data), len(data), np.int64)
    np.minimum.at(first, root, here)
    doc = docs[text_of]
    marked = np.flatnonzero((to_stop >= length) & (doc[first[root]] < doc))
    cuts = np.searchsorted(marked, ends - sizes)
    return [m - lo for m, lo in zip(np.split(marked, cuts[1:]), ends - sizes, strict=True)]


def _united(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that strings of `width` bytes at the sorted `starts` cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > width)
    return starts[np.append(0, new + 1)], starts[np.append(new, len(starts) - 1)] + width


# Blocks

def _write_blocks(docs: DataFrame, folder: str, length: int) -> DataFrame:
    """Blocks of documents as files, and for each block its texts' digests: block,
    digest, ids, places, and the bytes of all."""
    shape = "block long, digest binary, ids array<long>, places array<int>, n_bytes long"
    arrow = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, held, size = task.partitionId() << 24, [], 0

        def cut() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] or 0))
            store, name = fs.FileSystem.from_uri(f"{folder}/{number}")
            store.create_dir(name.rpartition("/")[0])
            table = pa.table({"doc_id": pa.array([h[0] for h in held], pa.int64()), "text": pa.array([h[1] for h in held], pa.binary())})
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as out, pa.ipc.new_file(
                    out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            store.move(f"{name}.{task.taskAttemptId()}", name)
            same = defaultdict(list)
            for place, (doc_id, text) in enumerate(held):
                if doc_id is not None and len(text) >= length:
                    same[hashlib.md5(text).digest()].append((doc_id, place))
            rows = [(number, d, [x[0] for x in v], [x[1] for x in v], sum(len(held[x[1]][1]) for x in v)) for d, v in same.items()]
            rows = rows or [(number, None, [], [], 0)]
            return pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if held and (len(held) == BLOCK_ROWS or size + len(data) > BLOCK_BYTES):
                    yield cut()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, data))
                size += len(data)
        if held:
            yield cut()

    return materialize(texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, shape), "run-blocks")


def _load(folder: str, number: int) -> tuple[list, list[bytes]]:
    store, name = fs.FileSystem.from_uri(f"{folder}/{number}")
    with store.open_input_file(name) as source:
        table = pa.ipc.open_file(source).read_all()
    return table["doc_id"].to_pylist(), table["text"].to_pylist()


def _copies(digests: DataFrame) -> DataFrame:
    """block and the places of documents whose whole text a smaller document has."""
    firsts = digests.where("digest IS NOT NULL").groupBy(F.col("digest").alias("__d")).agg(F.min(F.array_min("ids")).alias("first"))
    joined = digests.join(firsts, F.col("digest") == F.col("__d"), "left")
    later = F.expr("transform(filter(arrays_zip(ids, places), x -> x.ids > first), x -> x.places)")
    return joined.groupBy("block").agg(F.flatten(F.collect_list(later)).alias("copies"))


def _dealt(blocks: DataFrame, count: int) -> DataFrame:
    return blocks.repartition(max(1, -(-count // 4)), "block")


# Shared anchors and regions

class _Keys:
    """The distinct anchors of a block in ascending order, dealt to buckets; the same
    each time it is made."""

    def __init__(self, ids: list, texts: list[bytes], skip: set[int], buckets: int, length: int):
        found = list(_block_anchors(ids, texts, skip, length)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        self.place, self.at, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        # Documents ascend in a block: the least place has the least doc_id.
        order = np.lexsort((self.place, self.hash))
        place, key = self.place[order], self.hash[order]
        first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key)) - 1
        doc = np.array([i or 0 for i in ids], np.int64)
        self.key, self.first, self.several = key[first], place[first], doc[place[first]] != doc[place[last[:len(first)]]]
        bucket = (_mixed(self.key) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def bucket(self, b: int) -> np.ndarray:
        return self.order[self.cuts[b]:self.cuts[b + 1]]


def _shared(blocks: DataFrame, folder: str, buckets: int, length: int) -> DataFrame:
    """block and, for each bucket of its anchors, a bit for each that says whether several
    places have it, and the first of those (block and place, as one number). An anchor goes
    as KEY_BYTES of its hash and two bytes for its place: what is sent follows the bytes of
    the texts, however many blocks and buckets there are."""
    shape = "bucket int, block long, keys binary, places binary"
    arrow = _arrow(shape)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, texts = _load(folder, number)
                keys = _Keys(ids, texts, set(copies), buckets, length)
                tag = (keys.first | keys.several << 15).astype(np.uint16)[keys.order]
                code = (keys.key >> np.uint64(64 - 8 * KEY_BYTES)).astype("<u8")[keys.order]
                code = code.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                found = np.flatnonzero(np.diff(keys.cuts))
                for lo in range(0, len(found), 1000):
                    part = found[lo:lo + 1000].tolist()
                    cuts = [(keys.cuts[b], keys.cuts[b + 1]) for b in part]
                    row = {"bucket": part, "block": [number] * len(part), "keys": [code[x:y].tobytes() for x, y in cuts], "places": [tag[x:y].tobytes() for x, y in cuts]}
                    yield pa.RecordBatch.from_pydict(row, schema=arrow)

    out = _arrow("block long, bucket int, shared binary, firsts binary")

    def answer(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        tags = [np.frombuffer(r[2], np.uint16) for r in rows]
        wide = np.zeros((sum(map(len, tags)), 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, KEY_BYTES)
        keys = wide.view("<u8").ravel()
        # Number and place of a block's document name it; the order does not matter.
        docs = np.concatenate([np.int64(r[0]) * (1 << 12) + (t & 0x7FFF) for r, t in zip(rows, tags, strict=True)])
        several = np.concatenate([t >> 15 for t in tags]).astype(bool)
        order = np.lexsort((docs, keys))
        there = keys[order]
        first = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
        size = np.diff(np.append(first, len(there)))
        shared = (size > 1) | np.logical_or.reduceat(several[order], first)
        least, hit = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        least[order], hit[order] = np.repeat(docs[order[first]], size), np.repeat(shared, size)
        lo, found = 0, []
        for r, t in zip(rows, tags, strict=True):
            mine = hit[lo:lo + len(t)]
            if mine.any():
                found.append((r[0], bucket, np.packbits(mine).tobytes(), least[lo:lo + len(t)][mine].tobytes()))
            lo += len(t)
        for lo in range(0, len(found), 1000):
            columns = zip(*found[lo:lo + 1000], strict=True)
            yield pa.RecordBatch.from_pydict(dict(zip(out.names, map(list, columns), strict=True)), schema=out)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != current and rows:
                    yield from answer(current, rows)
                    rows = []
                current = bucket
                rows.append(tuple(row))
        if rows:
            yield from answer(current, rows)

    sent = blocks.mapInArrow(send, shape)
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(back, "block long, bucket int, shared binary, firsts binary")


REGION = "family long, doc_id long, block long, place int, start long, text binary"


def _regions(blocks: DataFrame, folder: str, buckets: int, length: int) -> DataFrame:
    """The bytes around shared anchors, by the first document that has these."""
    arrow = _arrow(REGION)
    reach = length - anchor_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, copies, found = [c[i].as_py() for c in batch.columns]
                ids, texts = _load(folder, number)
                keys = _Keys(ids, texts, set(copies), buckets, length)
                shared, firsts = np.zeros(len(keys.key), bool), np.zeros(len(keys.key), np.int64)
                for f in found:
                    mine = keys.bucket(f["bucket"])
                    mine = mine[np.unpackbits(np.frombuffer(f["shared"], np.uint8), count=len(mine)).astype(bool)]
                    shared[mine], firsts[mine] = True, np.frombuffer(f["firsts"], np.int64)
                spot = np.searchsorted(keys.key, keys.hash)
                hit = shared[spot]
                place, at, family = keys.place[hit], keys.at[hit], firsts[spot[hit]]
                order = np.lexsort((at, family, place))
                place, at, family = place[order], at[order], family[order]
                lo, hi = at - reach, at + length
                new = np.append(True, (place[1:] != place[:-1]) | (family[1:] != family[:-1]) | (lo[1:] > hi[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(new)) - 1
                rows = zip(family[first].tolist(), place[first].tolist(), np.maximum(lo[first], 0).tolist(), hi[last].tolist(), strict=True)
                out: dict[str, list] = {c: [] for c in arrow.names}
                size = 0
                for f, p, a, b in rows:
                    # A long region is cut so that no string of `length` bytes is lost.
                    b = min(b, len(texts[p]))
                    for c in range(a, max(a + 1, b - length + 1), SEGMENT):
                        text = texts[p][c:min(b, c + SEGMENT + length - 1)]
                        for name, value in zip(arrow.names, (f, ids[p], number, p, c, text), strict=True):
                            out[name].append(value)
                        size += len(text)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pydict(out, schema=arrow)
                        out, size = {c: [] for c in arrow.names}, 0
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return materialize(blocks.mapInArrow(run, REGION), "run-regions")


# Marks

MARK = (
    "block long, places array<int>, begins array<long>, ends array<long>, "
    "bucket int, keys binary, regions binary, starts binary, docs binary, blocks binary, spots binary, bases binary"
)


def _marks(regions: DataFrame, length: int) -> DataFrame:
    """block, places, begins, ends: spans to remove."""
    spark = regions.sparkSession
    sizes = materialize(regions.groupBy("family").agg(F.sum(F.length("text")).alias("n_bytes")), "run-families")
    large = sizes.where(F.col("n_bytes") > CHUNK)
    total, divided = (d.agg(F.sum("n_bytes")).first()[0] or 0 for d in (sizes, large))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(least, -(-total // SHARD)), max(least, -(-divided // BUCKET))
    # Written, so that its small size is known: then the join need not shuffle the regions.
    parts = materialize(large.select(F.col("family").alias("__f"), F.ceil(F.col("n_bytes") / CHUNK).alias("chunks")), "run-divided")
    cut = regions.join(parts, F.col("family") == F.col("__f"), "left").drop("__f")
    part = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    shard = F.pmod(F.xxhash64("family", part), F.lit(shards)).cast("int")
    dealt = cut.select(shard.alias("shard"), F.col("chunks").isNotNull().alias("divided"), "doc_id", "block", "place", "start", "text")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "block", "place", "start")
    arrow = _arrow(MARK)

    def shard_marks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts, docs, at = [], [], {}
        for _, doc, *_, text in rows:
            if text not in at:
                at[text] = len(texts)
                texts.append(text)
                docs.append(doc)
        found = repeats(texts, np.array(docs, np.int64), length)
        marks: dict[int, list[tuple]] = defaultdict(list)
        fresh = []
        for split, doc, block, place, start, text in rows:
            n, every = at[text], np.arange(max(0, len(text) - length + 1))
            starts = found[n] if docs[n] == doc else every
            for a, b in zip(*[x.tolist() for x in _united(starts, length)], strict=True):
                marks[block].append((place, start + a, start + b))
            if split and docs[n] == doc and len(new := np.setdiff1d(every, starts, assume_unique=True)):
                data = np.frombuffer(text, np.uint8)
                keys = np.stack([string_hashes(data, length, m)[new] for m in (MULTIPLIER, SECOND)], axis=1)
                fresh.append((keys, [doc, block, place, start], new))
        for lo in range(0, len(fresh), 5000):
            yield from _sent(fresh[lo:lo + 5000], buckets, arrow)
        if marks:
            yield _spans(marks, arrow)

    def meet(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]).reshape(-1, 2)
        regions = [np.frombuffer(r[1], np.uint16) for r in rows]
        docs, blocks, spots, bases = (
            np.concatenate([np.frombuffer(r[i], np.int64)[of] for r, of in zip(rows, regions, strict=True)]) for i in range(3, 7))
        starts = bases + np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows])
        order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
        there = keys[order]
        first = np.flatnonzero(np.append(True, (there[1:] != there[:-1]).any(axis=1)))
        low = np.repeat(docs[order[first]], np.diff(np.append(first, len(order))))
        hit = order[docs[order] > low]
        hit = hit[np.lexsort((starts[hit], spots[hit], blocks[hit]))]
        marks: dict[int, list[tuple]] = defaultdict(list)
        for text in np.split(hit, 1 + np.flatnonzero((blocks[hit][1:] != blocks[hit][:-1]) | (spots[hit][1:] != spots[hit][:-1]))):
            if len(text):
                spans = zip(*[x.tolist() for x in _united(np.unique(starts[text]), length)], strict=True)
                marks[int(blocks[text[0]])] += [(int(spots[text[0]]), a, b) for a, b in spans]
        if marks:
            yield _spans(marks, arrow)

    def each(step):
        """Rows of equal first column, one after the other, to `step`."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, rows = None, []
            for batch in batches:
                for number, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if number != current and rows:
                        yield from step(rows)
                        rows = []
                    current = number
                    rows.append(tuple(row))
            if rows:
                yield from step(rows)
        return run

    found = materialize(dealt.mapInArrow(each(shard_marks), MARK), "run-marks")
    spans = ["block", "places", "begins", "ends"]
    fresh = found.where("bucket IS NOT NULL").select("bucket", "keys", "regions", "starts", "docs", "blocks", "spots", "bases")
    again = fresh.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(each(meet), MARK)
    return found.where("bucket IS NULL").select(*spans).unionByName(again.select(*spans))


def _spans(marks: dict[int, list[tuple]], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [list(map(list, zip(*v, strict=True))) for v in marks.values()]
    given = {"block": list(marks), "places": [c[0] for c in columns], "begins": [c[1] for c in columns], "ends": [c[2] for c in columns]}
    return pa.RecordBatch.from_pydict({n: given.get(n, [None] * len(marks)) for n in arrow.names}, schema=arrow)


def _sent(fresh: list[tuple], buckets: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hashes of new strings, a row per bucket. A string has two bytes each for its region
    and its start there; document, block, place and start of a region go once a row."""
    keys, starts = (np.concatenate([f[i] for f in fresh]) for i in (0, 2))
    known, of = np.array([f[1] for f in fresh], np.int64), np.repeat(np.arange(len(fresh)), [len(f[2]) for f in fresh])
    bucket = (_mixed(keys[:, 0]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[b]:cuts[b + 1]]
        used, region = np.unique(of[mine], return_inverse=True)
        docs, blocks, spots, bases = (known[used, i].tobytes() for i in range(4))
        row = {
            "bucket": b, "keys": keys[mine].tobytes(), "regions": region.astype(np.uint16).tobytes(), "starts": starts[mine].astype(np.uint16).tobytes(),
            "docs": docs, "blocks": blocks, "spots": spots, "bases": bases,
        }
        yield pa.RecordBatch.from_pydict({n: [row.get(n)] for n in arrow.names}, schema=arrow)


# Result

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """RESULT for each row of `docs` (doc_id, text), and the remaining text (bytes that
    may end inside a character) if `texts`."""
    spark = docs.sparkSession
    folder = work_dir(spark, "run-texts")
    digests = _write_blocks(docs, folder, length)
    copies = materialize(_copies(digests), "run-copies")
    count, n_bytes = digests.agg(F.countDistinct("block"), F.sum("n_bytes")).first()
    expected = (n_bytes or 0) * 2 // (length - anchor_width(length) + 2)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET))
    # A block's rows are dealt once; the aggregate and the join keep them where they are.
    shared = _dealt(_shared(_dealt(copies, count), folder, buckets, length), count).groupBy(F.col("block").alias("__b")).agg(
        F.collect_list(F.struct("bucket", "shared", "firsts")).alias("found"))
    met = copies.join(shared, F.col("block") == F.col("__b")).select("block", "copies", "found")
    marks = _marks(_regions(met, folder, buckets, length), length)
    per_block = marks.groupBy(F.col("block").alias("__b")).agg(F.collect_list(F.struct("places", "begins", "ends")).alias("spans"))
    whole = _dealt(copies.join(per_block, F.col("block") == F.col("__b"), "left").drop("__b"), count)
    shape = RESULT + (", kept binary" if texts else "")
    arrow = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, gone, spans = [c[i].as_py() for c in batch.columns]
                ids, bodies = _load(folder, number)
                cut: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for s in spans or ():
                    for place, a, b in zip(s["places"], s["begins"], s["ends"], strict=True):
                        cut[place].append((a, b))
                for place in gone:
                    cut[place] = [(0, len(bodies[place]))]
                out: dict[str, list] = {c: [] for c in arrow.names}
                for place, (doc, body) in enumerate(zip(ids, bodies, strict=True)):
                    kept, at, runs = [], 0, 0
                    for a, b in sorted(cut.get(place, ())):
                        if a > at or not runs:
                            kept.append(body[at:a])
                            runs += 1
                        at = max(at, b)
                    kept.append(body[at:])
                    rest = b"".join(kept)
                    row = (doc, len(body), len(body) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest)
                    for c, v in zip(arrow.names, row, strict=False):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return whole.select("block", "copies", "spans").mapInArrow(run, shape)
