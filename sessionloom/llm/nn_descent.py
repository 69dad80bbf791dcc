"""Operator 3: nearest neighbours by cosine, from a graph made by NN-descent.

1. Equal vectors become one node; its members are kept apart. The graph's nearness is
   cosine - 1 of float32 directions, taken from their differences where they are close,
   so that float32 tells the members of a tight group apart.
2. First neighbours: trees of random hyperplanes cut the nodes into leaves of about
   LEAF nodes (a leaf that is larger, as of near-equal vectors, is split by hash, in
   another way in each tree);
   each leaf compares its nodes.
3. NN-descent: neighbours of neighbours are likely neighbours. A round joins every
   node with up to SAMPLE neighbours and up to SAMPLE nodes that have it as a
   neighbour, new ones first; the nodes that meet at one centre are compared, and each
   keeps its `degree` nearest. Rounds end when few neighbours change. Sampling is part of the
   method: what a round leaves out, later rounds reach.
4. Queries walk the graph: from its entry nodes a query looks at the neighbours of the
   nearest nodes that it has not yet visited, keeps the `beam` nearest, and stops
   when these hold no unvisited one. Equal queries walk once. Nodes are scored exactly, in
   double precision, on the given vectors, so that vectors whose directions float32 can't
   tell apart are ranked as they are; a node's members have equal vectors, and those with
   the smallest ids come first.

Layout: nodes are numbered in the order of their ids and lie in blocks of up to `size`
numbers, each block one row of arrays. Blocks send each other messages, a row for each two
blocks and step; a step is one shuffle of messages by block. A neighbour is one 64-bit
number, its distance's bits above its number, so the order of such numbers is that of
nearness, ties by the smaller id. A round is done in waves, each for part of the centres,
as its messages hold some 25 times the vectors.

Cases: vectors that are null, empty, zero, hold a null or non-finite component, or
have another length than most take no part, nor do rows without an id; rows that
repeat id and vector count once; ties go to the smaller id; a query with fewer
candidates gets all; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sessionloom.llm.common import _arrow, materialize, slices

LEAF, TREES, SAMPLE = 256, 8, 12
SEED = 5
#: Nodes of a block at most, blocks that a small table has at least, nodes for each wave.
BLOCK, BLOCKS, WAVE, WAVES = 16_384, 48, 65_536, 6
#: Leaves that meet in one task, queries in one row.
CELL, ASKED = 32, 512
#: Below this distance (1 - cosine), it is taken from the difference of two directions.
CLOSE = 0.01
NONE = np.uint64((1 << 64) - 1)
NOBODY = np.uint32((1 << 32) - 1)
LOW = np.uint64((1 << 32) - 1)
HALF = np.uint64(32)
MESSAGE = "block long, kind string, size long, data binary"
#: Bytes of messages that a task gives to Spark at once.
BATCH = 8 << 20

Message = tuple[int, str, int, bytes]


@dataclass
class Store:
    """The nodes: block, ids, flags (1: asked, 2: has several members) and data, a row for each block."""

    rows: DataFrame
    total: int
    blocks: int
    size: int
    width: int
    wide: str


# Messages

def _rows(messages: Iterable[Message]) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("size", pa.int64()), ("data", pa.binary())])
    some, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), arrow.types, strict=True)], schema=arrow)

    for m in messages:
        some.append(m)
        held += len(m[3])
        if held > BATCH or len(some) >= 5000:
            yield batch()
            some, held = [], 0
    if some:
        yield batch()


def _each(rows: DataFrame, step: Callable[[int, dict], Iterable[Message]]) -> DataFrame:
    """What `step` makes of every row by itself: its block and its columns as one dictionary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                row = {n: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for n, x in row.items()}
                yield from _rows(step(row["block"], row))

    return rows.mapInArrow(run, MESSAGE)


def _meet(rows: DataFrame, step: Callable[[int, dict[str, list]], Iterable[Message]]) -> DataFrame:
    """What `step` makes of all messages of a block, by kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = defaultdict(list)
        block = -1
        for batch in batches:
            block = batch.column(0)[0].as_py() if batch.num_rows else block
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                got[kind].append(data.as_buffer())
        yield from _rows(step(block, got))

    return rows.select("block", "kind", "size", "data").groupBy("block").applyInArrow(run, MESSAGE)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(data: bytes, *kinds: str | tuple[str, int]) -> list[np.ndarray]:
    """The arrays of a message; a kind is a dtype, or a dtype and the numbers in a row."""
    types = [(np.dtype(k), 1) if isinstance(k, str) else (np.dtype(k[0]), k[1]) for k in kinds]
    n = len(memoryview(data)) // sum(t.itemsize * w for t, w in types)
    out, at = [], 0
    for (t, w), kind in zip(types, kinds, strict=True):
        a = np.frombuffer(data, t, n * w, at)
        out.append(a if isinstance(kind, str) else a.reshape(n, w))
        at += n * w * t.itemsize
    return out


def _all(messages: list, *kinds: str | tuple[str, int]) -> list[np.ndarray]:
    parts = [_unpack(m, *kinds) for m in messages] or [_unpack(b"", *kinds)]
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True)]


def _dealt(target: np.ndarray, kind: str, *columns: np.ndarray) -> Iterator[Message]:
    """The columns cut by the block each row goes to."""
    for block, order in _cut(target):
        yield block, kind, len(order), _pack(*(c[order] for c in columns))


def _cut(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(target):
        return
    order = np.argsort(target.astype(np.uint16) if target.max() < 1 << 16 else target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for part in np.split(order, cuts):
        yield int(target[part[0]]), part


def _ranks(group: np.ndarray) -> np.ndarray:
    """The place of each entry in its group; equal entries lie together."""
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    return np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Even 64-bit hashes of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


# Vectors

def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and data, the bytes of the vector, for rows that may take part. Numbers that are
    given as float32 stay so; minus zero and zero are equal numbers."""
    wide = _wide(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if wide == "f4" else "array<double>").alias("vector"))
    schema = "vec_id long, data binary"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, lists = batch.column(0), batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(wide) + np.dtype(wide).type(0)
            ends = np.cumsum(np.r_[0, n])
            odd, some = (np.cumsum(np.r_[0, x])[ends] for x in (~np.isfinite(flat), flat != 0))
            fine = (np.diff(odd) == 0) & (np.diff(some) > 0)
            offsets = (ends * np.dtype(wide).itemsize).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([ids, data], schema=arrow).filter(pa.array(fine))

    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).mapInArrow(run, schema)


def _wide(vectors: DataFrame, vector: str) -> str:
    kind = vectors.schema[vector].dataType
    return "f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "f8"


def _matrix(data: bytes, width: int, wide: str) -> np.ndarray:
    return np.frombuffer(data, wide).reshape(-1, width).astype(np.float64)


def directions(v: np.ndarray) -> np.ndarray:
    """The directions of the rows of `v` as float32 numbers."""
    v = v / np.abs(v).max(1, keepdims=True, initial=0)  # no overflow in the norm
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v.astype(np.float32)


def distances(m: np.ndarray, close: float = CLOSE) -> np.ndarray:
    """1 - cosine of each two rows of each matrix in `m` (sets, rows, numbers), as float32."""
    out = np.maximum(1 - m @ m.transpose(0, 2, 1), 0)
    s, i, j = np.nonzero(out < close)
    s, i, j = (x[i < j] for x in (s, i, j))
    for lo in range(0, len(s), 1 << 15):
        at = slice(lo, lo + (1 << 15))
        a, b = (m[s[at], x[at]].astype(np.float64) for x in (i, j))
        a, b = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (a, b))
        d = (np.einsum("ij,ij->i", a - b, a - b) / 2).astype(np.float32)
        out[s[at], i[at], j[at]] = out[s[at], j[at], i[at]] = d
    return out


def _keys(distance: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers in the order of nearness, then of the other node. Distances are not below zero."""
    return np.ascontiguousarray(distance, np.float32).view(np.uint32).astype(np.uint64) << HALF | other.astype(np.uint64)


def stored(rows: DataFrame, asks: Column, wide: str) -> Store | None:
    """Equal vectors as one node, numbered in the order of their smallest ids."""
    each = rows.withColumn("asked", F.coalesce(asks, F.lit(False)))
    nodes = materialize(each.groupBy("data").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.max("asked").alias("asked")), "nn-nodes")
    n = F.length("data")
    total, least, most = nodes.agg(F.count("*"), F.min(n), F.max(n)).first()
    if not total:
        return None
    if least != most:
        most = rows.distinct().groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").first()["n"]
        nodes = nodes.where(n == most)
        total = nodes.count()
    size = min(BLOCK, max(512, math.ceil(total / BLOCKS)))
    schema = "part int, seq int, ids binary, flags binary, data binary"
    arrow = _arrow(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def cut(count: int) -> pa.RecordBatch:
            nonlocal held, seq
            whole = pa.Table.from_batches(held)
            some, held = whole.slice(0, count).combine_chunks(), whole.slice(count).to_batches()
            ids, last = (some[c].to_numpy() for c in ("least", "most"))
            flags = some["asked"].to_numpy().astype(np.uint8) + 2 * (ids != last).astype(np.uint8)
            row = [part, seq, ids.tobytes(), flags.tobytes(), b"".join(some["data"].to_pylist())]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                yield cut(size)
        if sum(b.num_rows for b in held):
            yield cut(size)

    sorted_ = nodes.repartitionByRange("least", "data").sortWithinPartitions("least", "data")
    kept = materialize(sorted_.select("least", "most", "asked", "data").mapInArrow(blocks, schema), "nn-sorted")
    _forget(nodes)
    counts = dict(kept.groupBy("part").agg(F.sum(F.length("flags"))).collect())
    starts = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts) + 1))]).tolist()
    if total >= 1 << 32:
        raise ValueError("more nodes than 32 bits can number")
    width = most // np.dtype(wide).itemsize
    # Partitions may be many and small; blocks are not.
    start = F.element_at(F.expr(f"array({', '.join(map(str, starts))})"), F.col("part") + 1) + F.col("seq") * F.lit(size)

    def pieces(first: int, row: dict) -> Iterator[Message]:
        pos = first + np.arange(len(memoryview(row["flags"])))
        columns = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("flags", np.uint8), ("data", wide)))
        yield from _dealt(pos // size, "", pos, *(c.reshape(len(pos), -1) for c in columns))

    row_schema = "block long, ids binary, flags binary, data binary"
    row_arrow = _arrow(row_schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = -1, []
        for batch in batches:
            block = batch.column(0)[0].as_py()
            got += [x.as_buffer() for x in batch.column(1)]
        pos, *columns = _all(got, "i8", "i8", "u1", (wide, width))
        row = [block, *(_pack(x[np.argsort(pos)]) for x in columns)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, row_arrow.types, strict=True)], schema=row_arrow)

    parts = _each(kept.select(start.cast("long").alias("block"), "ids", "flags", "data"), pieces)
    made = materialize(parts.select("block", "data").groupBy("block").applyInArrow(whole, row_schema), "nn-store")
    _forget(kept)
    return Store(made, total, -(-total // size), size, width, wide)


def _forget(table: DataFrame) -> None:
    """Delete a table of `materialize` that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.split("/nn-", 1)[0] + "/nn-" + f.split("/nn-", 1)[1].split("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()  # shuffle files stay until the driver's garbage is collected


# The graph: for each block a message G with the neighbours of its nodes and their age
# (0: compared, 1: new, 2: new in this round), and a message W with the distances of their last ones.

def _graph(data: bytes, degree: int) -> tuple[np.ndarray, np.ndarray]:
    keys, age = _unpack(data, ("u8", degree), ("u1", degree))
    return keys, age


def first_pairs(store: Store, trees: list[int], degree: int) -> DataFrame:
    """Messages C (node, neighbour) from leaves of trees of random hyperplanes."""
    depth = max(0, math.ceil(math.log2(max(1, store.total) / LEAF)))
    cells = 1 << max(0, depth - int(math.log2(CELL)))
    size, width, wide = store.size, store.width, store.wide

    def leaves(codes: np.ndarray, tree: int) -> np.ndarray:
        planes = np.random.default_rng([SEED, tree]).standard_normal((width, max(depth, 1))).astype(np.float32)
        return (codes @ planes > 0)[:, :depth] @ (1 << np.arange(depth, dtype=np.int64))

    def counted(heavy: set[int] | None) -> Callable[[int, dict], Iterable[Message]]:
        def step(block: int, row: dict) -> Iterator[Message]:
            codes = directions(_matrix(row["data"], width, wide))
            for tree in trees:
                leaf = leaves(codes, tree)
                at = leaf % cells * TREES + tree
                what = at if heavy is None else leaf[np.isin(at, list(heavy))] * TREES + tree
                for x, n in zip(*np.unique(what, return_counts=True), strict=True):
                    yield int(x), "", int(n), b""

        return step

    def over(most: int, heavy: set[int] | None = None) -> dict[int, int]:
        found = _each(store.rows.select("block", "data"), counted(heavy)).groupBy("block").agg(F.sum("size").alias("n"))
        return dict(found.where(F.col("n") > most).collect())

    # The leaves of a cell that holds many more nodes than most are dealt one by one, large ones in parts.
    heavy = set(over(8 * CELL * LEAF))
    parts = {k: math.ceil(n / (2 * LEAF)) for k, n in over(2 * LEAF, heavy).items()} if heavy else {}

    def deal(block: int, row: dict) -> Iterator[Message]:
        codes = directions(_matrix(row["data"], width, wide))
        pos = block * size + np.arange(len(codes))
        for tree in trees:
            leaf = leaves(codes, tree)
            at, inner = leaf % cells * TREES + tree, leaf << 24
            if heavy:
                alone = np.isin(at, list(heavy))
                n = np.array([parts.get(x, 1) for x in (leaf * TREES + tree).tolist()])
                part = (_mix(pos * TREES + tree) % n.astype(np.uint64)).astype(np.int64)
                spread = (_mix(leaf) % np.uint64(cells)).astype(np.int64)
                at, inner = np.where(alone, (spread + part) % cells * TREES + tree, at), inner + np.where(alone, part, 0)
            yield from _dealt(at, "N", pos.astype(np.uint32), inner, codes)

    def compare(cell: int, got: dict[str, list]) -> Iterator[Message]:
        pos, leaf, codes = _all(got["N"], "u4", "i8", ("f4", width))
        order = np.lexsort((_mix(pos.astype(np.uint64) * np.uint64(TREES) + np.uint64(cell % TREES)), leaf))
        nodes, keys = [], []
        for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            for ids in np.array_split(group, math.ceil(len(group) / (2 * LEAF))):
                if len(ids) > 1:
                    near = _keys(distances(codes[ids][None])[0], pos[ids][None])
                    np.fill_diagonal(near, NONE)
                    near = np.sort(near, axis=1)[:, : min(degree, len(ids) - 1)]
                    nodes.append(np.repeat(pos[ids], near.shape[1]))
                    keys.append(near.ravel())
        if nodes:
            node = np.concatenate(nodes)
            yield from _dealt(node // np.uint32(size), "C", node, np.concatenate(keys))

    return _meet(_each(store.rows.select("block", "data"), deal), compare)


def _top(pairs: DataFrame, graph: DataFrame, size: int, degree: int, last: bool) -> DataFrame:
    """The `degree` nearest of each node, of its neighbours and the messages C. If `last`, the
    round is over: what was new has been compared, and what came in it is new."""
    def step(block: int, got: dict[str, list]) -> Iterator[Message]:
        keys, age = _graph(got["G"][0], degree)
        node, more = _all(got["C"], "u4", "u8")
        at = (node - np.uint32(block * size)).astype(np.int64)
        order = np.argsort(at.astype(np.uint16), kind="stable")
        at, more = at[order], more[order]
        rank = _ranks(at)
        made = keys.copy()
        for lo in range(0, int(rank.max(initial=-1)) + 1, 256):
            part = (rank >= lo) & (rank < lo + 256)
            rows, row = np.unique(at[part], return_inverse=True)
            place = rank[part] - lo
            for a in range(0, len(rows), 2048):
                mine = (row >= a) & (row < a + 2048)
                whole = np.full((len(rows[a:a + 2048]), degree + int(place[mine].max()) + 1), NONE)
                whole[:, :degree] = made[rows[a:a + 2048]]
                whole[row[mine] - a, degree + place[mine]] = more[part][mine]
                made[rows[a:a + 2048]] = _unique(whole)[:, :degree]
        old, now = (x & LOW for x in (keys, made))
        ages = np.full(made.shape, 2, np.uint8)
        for lo in range(0, len(made), 1024):
            s, i, j = np.nonzero(now[lo:lo + 1024, :, None] == old[lo:lo + 1024, None, :])
            ages[lo + s, i] = age[lo + s, j]
        ages[made == NONE] = 0
        count = int((ages == 2).sum())
        if last:
            ages = np.maximum(ages, 1) - 1
        yield block, "G", count, _pack(made, ages)
        yield block, "W", 0, _pack((made[:, -1] >> HALF).astype(np.uint32))

    return _meet(pairs.unionByName(graph.where("kind = 'G'")), step)


def _unique(keys: np.ndarray) -> np.ndarray:
    """Each row in order; of keys with the same other node, the first stays, NONE for the rest."""
    turned = np.sort(keys << HALF | keys >> HALF, axis=1)
    again = turned[:, 1:] >> HALF == turned[:, :-1] >> HALF
    turned[:, 1:][again] = NONE
    return np.sort(turned << HALF | turned >> HALF, axis=1)


def meetings(store: Store, graph: DataFrame, degree: int, number: int, waves: int) -> DataFrame:
    """Who meets at each centre (messages M to its own block), whose vectors that needs (R), and
    messages C from nodes that have a centre as a neighbour; size is the centre's wave."""
    size = store.size

    def order(node: np.ndarray, other: np.ndarray, age: np.ndarray) -> np.ndarray:
        """New ones first, then by hash: 32 bits."""
        h = _mix(node.astype(np.uint64) << HALF | other.astype(np.uint64) ^ np.uint64(SEED + 977 * number))
        return h >> np.uint64(33) | np.where(age > 0, np.uint64(0), np.uint64(1 << 31))

    def tell(block: int, row: dict) -> Iterator[Message]:
        """Messages E: other, node, distance, age for each neighbour."""
        keys, age = _graph(row["data"], degree)
        at = np.repeat(np.arange(block * size, block * size + len(keys)), degree)
        keys, age = keys.ravel(), age.ravel()
        fine = keys != NONE
        at, keys, age = at[fine], keys[fine], age[fine]
        other = (keys & LOW).astype(np.int64)
        near = np.sort(other)
        if (near[4 * SAMPLE:] == near[:-4 * SAMPLE]).any():
            # Of a node that many have as a neighbour, only those go that could be sampled.
            o = np.lexsort((order(other, at, age), other))
            o = o[_ranks(other[o]) < SAMPLE]
            at, keys, age, other = (x[o] for x in (at, keys, age, other))
        yield from _dealt(other // size, "E", other.astype(np.uint32), at.astype(np.uint32), (keys >> HALF).astype(np.uint32), age)

    def sample(block: int, got: dict[str, list]) -> Iterator[Message]:
        keys, age = _graph(got["G"][0], degree)
        n, wave = len(keys), block % waves
        centre = np.arange(block * size, block * size + n)
        own = order(centre[:, None], keys & LOW, age) << HALF | keys & LOW
        own[keys == NONE] = NONE
        own = np.sort(own, axis=1)[:, :SAMPLE]
        to, node, distance, new = _all(got["E"], "u4", "u4", "u4", "u1")
        at = (to - np.uint32(block * size)).astype(np.int64)
        # Who has a centre as a neighbour is a candidate for it, by the same distance.
        key = distance.astype(np.uint64) << HALF | node
        better = (new > 0) & (key >> HALF < keys[at, -1] >> HALF)
        if better.any():
            yield block, "C", wave, _pack(to[better], key[better])
        first = order(to, node, new)
        o = np.argsort((at.astype(np.uint64) << HALF) | first)
        rank = _ranks(at[o])
        o, rank = o[rank < SAMPLE], rank[rank < SAMPLE]
        back = np.full((n, SAMPLE), NONE)
        back[at[o], rank] = first[o] << HALF | node[o]
        both = np.concatenate([own, back], axis=1)
        # The node above, age below; a node that is there twice counts as new if either is.
        both = np.where(both == NONE, NONE, (both & LOW) << np.uint64(1) | both >> np.uint64(63))
        both = np.sort(both, axis=1)
        again = both[:, 1:] >> np.uint64(1) == both[:, :-1] >> np.uint64(1)
        both[:, 1:][again] = NONE
        met = np.where(both == NONE, NOBODY, (both >> np.uint64(1)).astype(np.uint32))
        fresh = (both != NONE) & (both & np.uint64(1) == 0)
        met[~fresh.any(1)] = NOBODY
        yield block, "M", wave, _pack(met, fresh.astype(np.uint8))
        wanted = np.unique(met)
        wanted = wanted[wanted != NOBODY]
        for there, o in _cut(wanted // np.uint32(size)):
            yield there, "R", wave, _pack(np.array([block], np.uint32), wanted[o])

    graph = graph.where("kind = 'G'")
    return _meet(_each(graph, tell).unionByName(graph), sample)


def descend(store: Store, graph: DataFrame, met: DataFrame) -> DataFrame:
    """Messages C, better pairs from the nodes that meet at the centres in `met`."""
    size, width, wide = store.size, store.width, store.wide

    def vectors(block: int, row: dict) -> Iterator[Message]:
        yield block, "V", 0, row["data"].to_pybytes()

    def answer(block: int, got: dict[str, list]) -> Iterator[Message]:
        """Messages X: node, distance of its last neighbour, direction."""
        for kind in ("M", "C"):
            for data in got[kind]:
                yield block, kind, 0, data.to_pybytes()
        if got["R"]:
            codes, far = directions(_matrix(got["V"][0], width, wide)), np.frombuffer(got["W"][0], np.uint32)
            for data in got["R"]:
                asker, *nodes = [np.frombuffer(data, np.uint32, 1), np.frombuffer(data, np.uint32, offset=4)]
                at = (nodes[0] - np.uint32(block * size)).astype(np.int64)
                yield int(asker[0]), "X", len(at), _pack(nodes[0], far[at], codes[at])

    def compare(block: int, got: dict[str, list]) -> Iterator[Message]:
        for data in got["C"]:
            yield block, "C", 0, data.to_pybytes()
        if not got["X"]:
            return
        met, fresh = _unpack(got["M"][0], ("u4", 2 * SAMPLE), ("u1", 2 * SAMPLE))
        active = np.flatnonzero(fresh.any(1))
        parts = sorted((_unpack(x, "u4", "u4", ("f4", width)) for x in got.pop("X")), key=lambda x: x[0][0])
        pos, far = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        far, codes = far.view(np.float32), np.concatenate([p[2] for p in parts])
        del parts
        far = np.where(np.isnan(far), np.float32(9), far)  # the bits of NONE: there is room
        nodes, keys = [], []
        for lo in range(0, len(active), 512):
            m, f = met[active[lo:lo + 512]], fresh[active[lo:lo + 512]].astype(bool)
            there = m != NOBODY
            slot = np.searchsorted(pos, np.where(there, m, pos[0]))
            limit = np.where(there, far[slot], np.float32(-1))
            near = distances(codes[slot])
            fit = near < limit[:, :, None]
            fit &= there[:, None, :]
            fit &= f[:, :, None] | f[:, None, :]
            fit[:, np.arange(2 * SAMPLE), np.arange(2 * SAMPLE)] = False
            s, i, j = np.nonzero(fit)
            nodes.append(m[s, i])
            keys.append(_keys(near[s, i, j], m[s, j]))
        node = np.concatenate(nodes)
        yield from _dealt(node // np.uint32(size), "C", node, np.concatenate(keys))

    vectors_ = _each(store.rows.select("block", "data"), vectors)
    return _meet(_meet(met.unionByName(vectors_).unionByName(graph.where("kind = 'W'")), answer), compare)


def build(store: Store, degree: int = 32, rounds: int = 6, still: float = 0.01) -> DataFrame:
    """The neighbour graph: messages G, at most `degree` neighbours for each node."""
    size = store.size

    def none(block: int, row: dict) -> Iterator[Message]:
        n = len(memoryview(row["flags"]))
        yield block, "G", 0, _pack(np.full((n, degree), NONE), np.zeros((n, degree), np.uint8))

    def kept(pairs: DataFrame, last: bool) -> DataFrame:
        made = materialize(_top(pairs, graph, size, degree, last), "nn-graph", ["kind"])
        _forget(graph)
        return made

    waves = min(WAVES, store.blocks, max(1, round(store.total / WAVE)))
    graph = materialize(_each(store.rows.select("block", "flags"), none), "nn-graph")
    for some in np.array_split(np.arange(TREES), waves):
        graph = kept(first_pairs(store, some.tolist(), degree), some[-1] == TREES - 1)
    for number in range(rounds):
        met = materialize(meetings(store, graph, degree, number, waves), "nn-meetings", ["size"])
        for wave in range(waves):
            graph = kept(descend(store, graph, met.where(F.col("size") == wave)), wave == waves - 1)
        _forget(met)
        if graph.agg(F.sum("size")).first()[0] <= still * degree * store.total:
            break
    return graph.where("kind = 'G'")


# The walk: messages Q hold the queries of a row, at most ASKED: number, vector, and the
# nodes, scores and visits of their beams.

def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of the rows of q and v, row by row, in double precision."""
    q, v = (x / np.abs(x).max(1, keepdims=True, initial=0) for x in (q, v))
    dot = np.einsum("ij,ij->i", q, v)
    return dot / np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", v, v))


def walk(store: Store, graph: DataFrame, degree: int, beam: int) -> DataFrame:
    """The nodes near each asked node: messages Q once no beam holds an unvisited node; a
    beam only gets nearer, so that point comes."""
    size, width, wide = store.size, store.width, store.wide
    rows = -(-size // ASKED)  # of queries, for each block
    wider = max(1, -(-store.blocks // 64))  # blocks that are scored together
    beams = ("u4", (wide, width), ("u4", beam), ("f8", beam), ("u1", beam))

    def home(pos: np.ndarray) -> np.ndarray:
        """The row of queries that an asked node's is in."""
        return pos // size * rows + pos % size // ASKED

    def begin(block: int, row: dict) -> Iterator[Message]:
        asked = np.flatnonzero(np.frombuffer(row["flags"], np.uint8) & 1)
        data = np.frombuffer(row["data"], wide).reshape(-1, width)
        for to, o in _cut(home(block * size + asked)):
            n, pos = len(o), (block * size + asked[o]).astype(np.uint32)
            yield to, "Q", n, _pack(pos, data[asked[o]], np.full((n, beam), NOBODY), np.full((n, beam), -9.0), np.ones((n, beam), np.uint8))
            # The first node it looks at is its own.
            yield to, "L", n, _pack(pos, pos)
        if len(asked):
            pos = (block * size + asked).astype(np.uint32)
            yield block, "F", len(asked), _pack(pos, pos)

    def front(row: int, got: dict) -> Iterator[Message]:
        pos, _, nodes, _, seen = _unpack(got["data"], *beams)
        q, i = np.nonzero(seen == 0)
        yield from _dealt(nodes[q, i] // np.uint32(size), "F", pos[q], nodes[q, i])

    def look(block: int, got: dict[str, list]) -> Iterator[Message]:
        """The neighbours of the nodes that queries have come to, L."""
        if got["F"]:
            q, node = _all(got["F"], "u4", "u4")
            keys, _ = _graph(got["G"][0], degree)
            keys = keys[(node - np.uint32(block * size)).astype(np.int64)]
            i, j = np.nonzero(keys != NONE)
            yield from _dealt(home(q[i].astype(np.int64)), "L", q[i], (keys[i, j] & LOW).astype(np.uint32))

    def ask(row: int, got: dict[str, list]) -> Iterator[Message]:
        """Nodes that are not in a query's beam go to where they are scored, S."""
        if not got["L"]:
            return
        pos, data, nodes, scores, _ = _unpack(got["Q"][0], *beams)
        q, node = _all(got["L"], "u4", "u4")
        both = np.unique(q.astype(np.uint64) << HALF | node)
        held = pos[:, None].astype(np.uint64) << HALF | nodes
        both = np.setdiff1d(both, held[nodes != NOBODY], assume_unique=True)
        node, at = (both & LOW).astype(np.uint32), np.searchsorted(pos, (both >> HALF).astype(np.uint32))
        for there, o in _cut(node // np.uint32(size * wider)):
            who, i = np.unique(at[o], return_inverse=True)
            yield there, "S", len(o), _pack(np.array([len(who), len(o)], np.uint32), pos[who], scores[who, -1], data[who], i.astype(np.uint32), node[o])

    def vectors(block: int, row: dict) -> Iterator[Message]:
        yield block // wider, "V", 0, np.array([block], np.uint32).tobytes() + row["data"].to_pybytes()

    def score(there: int, got: dict[str, list]) -> Iterator[Message]:
        """Messages T: query, node, score, if that is no lower than the last in the beam."""
        if not got["S"]:
            return
        parts = sorted(((int(np.frombuffer(x, np.uint32, 1)[0]), np.frombuffer(x, wide, offset=4).reshape(-1, width)) for x in got.pop("V")), key=lambda x: x[0])
        starts = {b: s for (b, _), s in zip(parts, np.cumsum([0, *(len(v) for _, v in parts)]).tolist(), strict=False)}
        start = np.array([starts.get(there * wider + k, 0) for k in range(wider)])
        given = np.concatenate([v for _, v in parts])
        codes = np.concatenate([directions(v.astype(np.float64)) for _, v in parts])
        for data in got["S"]:
            n, c = np.frombuffer(data, np.uint32, 2).tolist()
            pos, far, q = _unpack(memoryview(data)[8:8 + n * (12 + width * np.dtype(wide).itemsize)], "u4", "f8", (wide, width))
            i, node = _unpack(memoryview(data)[len(data) - 8 * c:], "u4", "u4")
            at = start[node // size - there * wider] + node % size
            qcodes, q = directions(q.astype(np.float64)), q.astype(np.float64)
            for lo in range(0, c, 1 << 14):
                a, b = i[lo:lo + (1 << 14)], at[lo:lo + (1 << 14)]
                # Float32 only rules out what is surely lower.
                hope = np.flatnonzero(np.einsum("ij,ij->i", qcodes[a], codes[b]) >= far[a] - 1e-4)
                a, b = a[hope], b[hope]
                s = cosines(q[a], given[b].astype(np.float64))
                fine = s >= far[a]
                a, y, s = a[fine], node[lo:lo + (1 << 14)][hope][fine], s[fine]
                yield from _dealt(home(pos[a].astype(np.int64)), "T", pos[a], y, s)

    def best(row: int, got: dict[str, list]) -> Iterator[Message]:
        pos, data, nodes, scores, _ = _unpack(got["Q"][0], *beams)
        q, node, score = _all(got["T"], "u4", "u4", "f8")
        i, j = np.nonzero(nodes != NOBODY)
        at = np.r_[i, np.searchsorted(pos, q)]
        node, score, seen = np.r_[nodes[i, j], node], np.r_[scores[i, j], score], np.r_[np.ones(len(i), np.uint8), np.zeros(len(q), np.uint8)]
        o = np.lexsort((node, -score, at))
        rank = _ranks(at[o])
        o, rank = o[rank < beam], rank[rank < beam]
        made = np.full((len(pos), beam), NOBODY), np.full((len(pos), beam), -9.0), np.ones((len(pos), beam), np.uint8)
        for x, y in zip(made, (node, score, seen), strict=True):
            x[at[o], rank] = y[o]
        yield row, "Q", int((made[2] == 0).sum()), _pack(pos, data, *made)

    vectors_ = _each(store.rows.select("block", "data"), vectors)
    start = materialize(_each(store.rows.select("block", "flags", "data"), begin), "nn-asked")
    state, reached, front_ = start.where("kind = 'Q'"), start.where("kind = 'L'"), start.where("kind = 'F'")
    links = _meet(front_.unionByName(graph), look).unionByName(reached)
    while True:
        asked = _meet(links.unionByName(state), ask)
        before, state = state, materialize(_meet(_meet(asked.unionByName(vectors_), score).unionByName(state), best), "nn-walk")
        _forget(before)
        if not state.agg(F.sum("size")).first()[0]:
            return state
        links = _meet(_each(state, front).unionByName(graph), look)


def found(state: DataFrame, store: Store, beam: int, most: int) -> DataFrame:
    """home, node and score of the `most` nearest nodes in each beam."""
    schema = "home long, node long, score double"
    arrow, width, wide = _arrow(schema), store.width, store.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                pos, _, nodes, scores, _ = _unpack(data.as_buffer(), "u4", (wide, width), ("u4", beam), ("f8", beam), ("u1", beam))
                i, j = np.nonzero(nodes[:, :most] != NOBODY)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pos[i].astype(np.int64), nodes[i, j].astype(np.int64), scores[i, j])], schema=arrow)

    return state.select("data").mapInArrow(run, schema)


def _named(store: Store) -> DataFrame:
    """node, vec_id (the smallest), asked, several and, for nodes with several members, data."""
    schema = "node long, vec_id long, asked boolean, several boolean, data binary"
    arrow, size = _arrow(schema), store.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, flags, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids, flags, data = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(flags.as_buffer(), np.uint8), data.as_py()
                n = len(data) // len(ids)
                own = [data[k * n:(k + 1) * n] if f & 2 else None for k, f in enumerate(flags.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.as_py() * size + np.arange(len(ids))), pa.array(ids), pa.array(flags & 1 > 0), pa.array(flags & 2 > 0), pa.array(own, pa.binary())], schema=arrow)

    return store.rows.select("block", "ids", "flags", "data").mapInArrow(run, schema)


def search(
    vectors: DataFrame, asks: Column, count: int = 5, degree: int = 32, beam: int = 200, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the `count` nearest rows found for
    every row for which `asks` (a condition on vec_id) holds."""
    rows = usable(vectors, key, vector)
    store = stored(rows, asks, _wide(vectors, vector))
    if store is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = build(store, degree)
    state = walk(store, graph, degree, beam)
    _forget(graph)
    named = _named(store)
    several = named.where("several")
    members, asked = named.where("not several").select("node", "vec_id"), named.where("asked and not several").select(F.col("vec_id").alias("query_id"), F.col("node").alias("home"))
    if not several.isEmpty():
        own = materialize(rows.join(several.select("node", "data"), "data").select("node", "vec_id").distinct(), "nn-members")
        w = Window.partitionBy("node").orderBy("vec_id")
        # No query needs more than count + 1 of a node's members: one of them may be itself.
        members = members.unionByName(own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count + 1).drop("rank"))
        asked = asked.unionByName(own.where(asks).select(F.col("vec_id").alias("query_id"), F.col("node").alias("home")))
    asked = materialize(asked, "nn-asked")
    # An id may have several vectors; none of its own rows counts.
    own_rows = asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    near = found(state, store, beam, count + own_rows).join(members, "node").select("home", "vec_id", "score").distinct()
    w = Window.partitionBy("home").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count + own_rows).drop("rank")
    out = asked.join(near, "home").where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "score").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
