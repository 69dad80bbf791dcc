"""Operator 7: near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprint: A-Z lower-cased; words are runs of anything but space and U+0009 to
U+000D; every shingle of `words` words (a shorter text is one shingle) is hashed
with XXH64, seed 42; a bit is set if it is set in over half of the hashes.

Links: distinct fingerprints that differ in at most `radius` bits.

1. A vantage-point tree over a bounded sample of fingerprints cuts all of them into
   shards. At a node with vantage point v and distance m, a fingerprint x lies
   inside if d(x, v) <= m. By the triangle bound, d(x, y) <= radius and x inside,
   y outside need d(x, v) > m - radius; so just the inside ones of that boundary
   are also sent outside, as visitors, and no pair is missed.
2. Each shard goes on in the same way by itself down to small leaves, whose pairs
   are compared. A shard keeps a union-find and emits one link per fingerprint to
   the root of its group, never all pairs.
3. Links are turned into components by rounds of joins (star contraction), written
   to the shared folder between rounds.

Cases: a null or blank text has fingerprint zero, linked like any other; a null
doc_id is kept and is never the smallest of a group unless there is no other;
repeated rows have one fingerprint and one component; an empty table gives an
empty result; texts of any length are hashed whole. Other columns are ignored.

`near_copies` finds texts whose sets of shingles have a Jaccard similarity of
`similarity` or more. First the fingerprints of all classes (texts of the same
lower-cased words) go through the trees as above; each class is linked to the first of
its fingerprint and each of these to that of its group in the shard. A link that holds
for the whole sets of shingles joins two classes. Similar texts whose fingerprints lie
further apart are found between the groups so far: classes are dealt to shards by KEYS
pairs of smallest shingle hashes (two similar texts share none with a chance of at most
(1 - similarity^2)^KEYS; a pair is missed only if neither way links it). In a shard every two are compared by size and by a parity sketch of
their distinct shingles, which only rule out pairs that cannot be similar enough. The
nearest of the others, as few as connect the shard, are checked on the whole sets of
shingles. Where a link fails, all pairs of its family that a good link does not connect
are checked likewise. A shard of over SHARD_BLOCK texts is cut into blocks, and each two
blocks meet in a task of their own.

Only distinct fingerprints are grouped, so a group of copies counts once. A shard
holds about SHARD_ROWS fingerprints; the tree is built from SAMPLE_PER_SHARD
fingerprints a shard, at most MAX_SAMPLE, and never from all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import map_batches, materialize
from sessionloom.llm.components import components, joined

SHARD_ROWS = 16_384
SAMPLE_PER_SHARD = 128
MAX_SAMPLE = 1 << 20
LEAF = 256
BLOCK = 200_000


def shingle_hashes(text: str, words: int) -> list[int]:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    parts = [w[i:] for i in range(words)] if len(w) > words else [w] if len(w) < words else [[x] for x in w]
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*parts, strict=False))
    return [xxhash.xxh64_intdigest(g, 42) for g in grams]


def majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, summed block by block."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = np.array(hashes[lo:lo + BLOCK], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def step(cols: dict[str, list]):
        found = [majority(shingle_hashes(t or "", words)) for t in cols["text"]]
        yield {"doc_id": cols["doc_id"], "fp": np.array(found, np.uint64).view(np.int64).tolist()}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, "doc_id long, fp long", step)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """The cuts of a vantage-point tree by level: `points` and `limits` of a
    complete binary tree, node 0 the root, 2i+1 inside, 2i+2 outside."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        size = (1 << depth) - 1
        self.points, self.limits = np.zeros(size, np.uint64), np.full(size, 64, np.int64)
        rng, parts = np.random.default_rng(seed), {0: np.unique(sample)}
        for node in range(size):
            part = parts.pop(node, np.empty(0, np.uint64))
            if len(part):
                self.points[node] = part[rng.integers(len(part))]
                d = distance(part, self.points[node])
                self.limits[node] = np.median(d)
                if node * 2 + 1 < size:
                    parts[2 * node + 1], parts[2 * node + 2] = part[d <= self.limits[node]], part[d > self.limits[node]]

    def shards(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the shards that they go to."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d, m = distance(fps[row], self.points[node]), self.limits[node]
            visits = (d <= m) & (d > m - radius)
            child = np.where(d <= m, 2 * node + 1, 2 * node + 2)
            row, node = np.append(row, row[visits]), np.append(child, 2 * node[visits] + 2)
        return row, node


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (self.up != (up := self.up[self.up])).any():
            self.up = up
        return self.up


def linked(fps: np.ndarray, radius: int, seed: int = 11) -> np.ndarray:
    """For the distinct `fps` of a shard the group of each."""
    groups, rng = Groups(len(fps)), np.random.default_rng(seed)
    stack = [np.arange(len(fps))]
    while stack:
        part = stack.pop()
        if len(part) > LEAF:
            d = distance(fps[part], fps[part[rng.integers(len(part))]])
            m = int(np.median(d))
            m -= d.max() == m
            inside, outside = d <= m, d > m - radius
            if outside.sum() <= 0.9 * len(part):
                stack += [part[inside], part[outside]]
                continue
        # A leaf, or a dense region that no boundary divides: block by block.
        for lo in range(0, len(part), LEAF):
            some = part[lo:lo + LEAF]
            for at in range(lo, len(part), 4096):
                rest = part[at:at + 4096]
                i, j = np.nonzero(distance(fps[some][:, None], fps[rest][None, :]) <= radius)
                a, b = some[i], rest[j]
                new = groups.up[a] != groups.up[b]
                groups.join(a[new], b[new])
            groups.up = groups.roots()
    return groups.roots()


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`, enough to connect
    every two that differ in at most `radius` bits."""
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD_ROWS))))
    if depth:
        want = min(MAX_SAMPLE, SAMPLE_PER_SHARD << depth)
        share = min(0.5, 1.2 * want / total)
        part = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
        sample = np.array([r.fp for r in part.limit(want).collect()], np.int64).view(np.uint64)
        tree = Tree(np.sort(sample), depth)

        def step(cols: dict[str, list]):
            fps = np.array(cols["fp"], np.int64)
            row, shard = tree.shards(fps.view(np.uint64), radius)
            yield {"fp": fps[row].tolist(), "shard": shard.tolist()}

        rows = map_batches(distinct.select("fp"), "fp long, shard long", step)
    else:
        rows = distinct.select("fp", F.lit(0).cast("long").alias("shard"))

    def link(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps = np.concatenate([p.column(0).to_numpy() for p in groups])
        root = linked(fps.view(np.uint64), radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[root[at]])], ["a", "b"])

    return rows.groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialize(fingerprints(docs, words), "simhash")
    smallest = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    group = components(links(smallest.select("fp"), radius))
    # A fingerprint without a link is its own component.
    of = (
        smallest.join(group, smallest["fp"] == group["node"], "left")
        .select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    )
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "component").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, rows["fp"] == named["__fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


KEYS = 8
#: Least bits of a sketch; one of a longer text has at least a bit for each shingle.
SKETCH = 512
#: Classes of a shard that are compared at once; a larger shard is cut into blocks.
SHARD_BLOCK = 4096
ROW = "doc_id long, row_hash long, class long, fp long, sketch binary, n long, keys array<long>"


def _shard_keys(hashes: np.ndarray) -> list[int]:
    """KEYS hashes, each of two smallest values over the shingles in an order of its own."""
    if not len(hashes):
        return []
    least = []
    for k in range(2 * KEYS):
        h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        least.append(int(((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min()))
    pairs = np.array(least, np.uint64).reshape(KEYS, 2)
    mixed = pairs[:, 0] * np.uint64(0x9E3779B97F4A7C15) + (pairs[:, 1] ^ np.arange(KEYS, dtype=np.uint64))
    return mixed.view(np.int64).tolist()


def _sketch(hashes: np.ndarray) -> bytes:
    """For each bit whether an odd number of the distinct shingles falls on it; a power
    of two of bits, no fewer than SKETCH or shingles. Every shingle that just one of two
    texts has flips one bit, so two sketches never differ in more bits than there are
    such shingles, nor do sketches folded to half their width."""
    bits = max(SKETCH, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _Sketches:
    """Sketches of texts in ascending order of shingles, so that widths ascend, too."""

    def __init__(self, codes: list[bytes]):
        sizes = np.array([len(c) for c in codes])
        cuts = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1]))
        self.start, self.end = cuts, np.append(cuts[1:], len(sizes))
        self.own = [np.frombuffer(b"".join(codes[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(self.start, self.end, strict=True)]
        self.level = np.repeat(np.arange(len(cuts)), self.end - self.start)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def differ(self, i: int, at: np.ndarray) -> np.ndarray:
        """Bits in which row i differs from the rows `at`, none of them narrower; wider
        ones are folded (a shingle's bit in the narrow sketch is that in the wide one,
        without its highest digits)."""
        base = self.level[i]
        mine, out = self.own[base][i - self.start[base]], np.empty(len(at), np.int64)
        for level in range(base, int(self.level[at[-1]]) + 1):
            part = self.level[at] == level
            out[part] = np.bitwise_count(self._fold(level, base)[at[part] - self.start[level]] ^ mine).sum(1, dtype=np.int64)
        return out

    def _fold(self, level: int, base: int) -> np.ndarray:
        if level == base:
            return self.own[level]
        if (level, base) not in self.folded:
            wide, width = self.own[level], self.own[base].shape[1]
            self.folded[level, base] = np.bitwise_xor.reduce(wide.reshape(len(wide), -1, width), axis=1)
        return self.folded[level, base]


def _described(docs: DataFrame, words: int) -> DataFrame:
    """ROW for every document; `class` is a hash of its lower-cased words, `fp` its fingerprint."""

    def step(cols: dict[str, list]):
        out: dict[str, list] = {k: [] for k in ("class", "fp", "sketch", "n", "keys")}
        for text in cols["text"]:
            w = (text or "").encode("utf-8", "surrogatepass").lower().split()
            hashes = shingle_hashes(text or "", words)
            kinds = np.unique(np.array(hashes, np.uint64))
            fp = int(np.uint64(majority(hashes)).view(np.int64))
            for k, v in zip(out, (xxhash.xxh64_intdigest(b" ".join(w)) - 2**63, fp, _sketch(kinds), len(kinds), _shard_keys(kinds)), strict=True):
                out[k].append(v)
        yield {k: cols[k] for k in ("doc_id", "row_hash")} | out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return map_batches(rows, ROW, step)


def _close(n: np.ndarray, sketch: _Sketches, label: np.ndarray, side: np.ndarray | None, similarity: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of different labels (and sides, if given) that can be similar
    enough; n ascends. All of them if `every`, else the nearest ones that connect the rows.

    A similarity s of sets of x and y shingles leaves (x + y)(1 - s)/(1 + s) shingles that
    just one has; more differing bits of the sketches rule a pair out for certain."""
    label, last = label.copy(), np.searchsorted(n, n / similarity + 1e-6, "right")
    slack = (1 - similarity) / (1 + similarity)
    for part in (1.0,) if every else (0.25, 0.5, 0.75, 1.0):
        for i in range(len(n) - 1):
            fit = label[i + 1:last[i]] != label[i]
            if side is not None:
                fit &= side[i + 1:last[i]] != side[i]
            at = np.flatnonzero(fit) + i + 1
            if not len(at):
                continue
            d = sketch.differ(i, at)
            near = d <= part * slack * (n[at] + n[i]) + 1e-6
            at = at[near]
            if not len(at):
                continue
            if not every:
                at = at[np.argsort(d[near], kind="stable")]
                labels, first = np.unique(label[at], return_index=True)
                at = at[first]
                label[np.isin(label, labels)] = label[i]
            yield np.full(len(at), i), at


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows once for each shard, or each pair of blocks of a large shard, that they are in."""
    dealt = rows.select(F.explode("keys").alias("key"), "class", "n", "sketch", "group")
    # The blocks of a large shard meet two by two, each two in a task of their own.
    large = dealt.groupBy("key").count().where(F.col("count") > SHARD_BLOCK).select("key", F.ceil(F.col("count") / SHARD_BLOCK).cast("long").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = dealt.join(large, "key", "left").withColumn("side", F.pmod(F.xxhash64("class", F.lit(9)), blocks))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.select(
        F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("shard"), "class", "n", "sketch", "group", "side",
        (F.col("side") != F.col("other")).alias("cross"),
    )


def _candidates(rows: DataFrame, similarity: float, every: bool = False) -> DataFrame:
    """Links (a, b), a below b, of classes to check. rows: class, n, sketch, keys, group.
    All pairs of a shard that can be near and are in different groups if `every`, else
    the nearest ones that connect each shard."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            n, names = shard["n"].to_numpy(), shard["class"].to_numpy()
            order = np.lexsort((names, n))
            codes = shard["sketch"].to_pylist()
            sketch = _Sketches([codes[k] for k in order])
            label = np.unique(shard["group"].to_numpy()[order], return_inverse=True)[1]
            side = shard["side"].to_numpy()[order] if shard["cross"][0].as_py() else None
            names, kept, size = names[order], [], 0
            for i, j in itertools.chain(_close(n[order], sketch, label, side, similarity, every), [(None, None)]):
                if i is not None:
                    kept.append((np.minimum(names[i], names[j]), np.maximum(names[i], names[j])))
                    size += len(i)
                if kept and (i is None or size >= BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*kept, strict=True)], schema=arrow)
                    kept, size = [], 0

    return _dealt(rows).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each shard that has several; shards lie together, and the last
    one of a batch may go on in the next."""
    rest: list[pa.RecordBatch] = []
    for last, batch in itertools.chain(((False, b) for b in batches), [(True, None)]):
        if batch is not None and batch.num_rows:
            rest.append(batch)
        if not rest:
            continue
        first, end = rest[0]["shard"][0].as_py(), rest[-1]["shard"][-1].as_py()
        if not last and first == end:
            continue
        every = pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if len(rest) > 1 else rest[0]
        of = every["shard"].to_numpy()
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rest = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True):
            if b == len(of) and not last:
                rest = [every.slice(a, b - a)]
            elif b - a > 1:
                yield every.slice(a, b - a)


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _grams(links: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The sorted distinct shingle hashes of every class that a link names."""
    named = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "class")
    # Written, so that its size is known: texts are then shuffled only if it is too large to be sent to their tasks.
    first = materialize(classes.join(named, "class").select("class", "of"), "copies-wanted")

    def sets(cols: dict[str, list]):
        found = [np.unique(np.array(shingle_hashes(t or "", words), np.uint64)).tobytes() for t in cols["text"]]
        yield {"class": cols["class"], "grams": found}

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    same = text["doc_id"].eqNullSafe(F.col("of.doc_id")) & (text["row_hash"] == F.col("of.row_hash"))
    return map_batches(text.join(first, same).dropDuplicates(["class"]).select("class", "text"), "class long, grams binary", sets)


def _checked(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The links, and whether their sets of shingles are similar enough."""

    def compare(cols: dict[str, list]):
        fit = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(cols["x"], cols["y"], strict=True)]
        yield {"a": cols["a"], "b": cols["b"], "fit": fit}

    side = lambda end, text: grams.select(F.col("class").alias(end), F.col("grams").alias(text))
    pairs = links.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return map_batches(pairs.select("a", "b", "x", "y"), "a long, b long, fit boolean", compare)


def _unlinked(checked: DataFrame, classes: DataFrame, group: DataFrame) -> DataFrame:
    """A link that fails can have stood in for others. All classes that links, good
    or failed, hold together make a family, and no near pair that shares a shard lies
    outside one. So the classes of families with a failed link, with their groups so far."""
    family = joined(group, checked.where("NOT fit")).select(F.col("node").alias("class"), F.col("component").alias("family"))
    odd = checked.where("NOT fit").join(family, F.col("a") == F.col("class")).select("family").distinct()
    rows = classes.join(family.join(odd, "family"), "class").join(group, F.col("class") == F.col("node"), "left")
    return rows.select("class", "n", "sketch", "keys", F.coalesce("component", "class").alias("group"))


def _near_fingerprints(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a below b, of classes that fingerprints of at most `radius` unlike
    bits hold together: each class to the first of its fingerprint, and these to one another
    as the trees link them."""
    firsts = materialize(classes.groupBy("fp").agg(F.min("class").alias("head")), "copies-fingerprints")
    at = lambda end: firsts.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_class"))
    near = links(firsts.select("fp"), radius).join(at("a"), "a").join(at("b"), "b").select(F.col("a_class").alias("x"), F.col("b_class").alias("y"))
    same = classes.join(firsts, "fp").select(F.col("head").alias("x"), F.col("class").alias("y"))
    pairs = near.unionByName(same).where("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _groups(docs: DataFrame, words: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, one row per class with its first document, and the group of
    every class that has links (node, component). Rows meet by class in this aggregate
    only, which combines them before they are sent."""
    rows = materialize(_described(docs, words), "copies-rows")
    of = F.struct("doc_id", "row_hash")
    classes = materialize(rows.groupBy("class").agg(
        F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.min_by(of, F.coalesce("doc_id", F.lit(-1))).alias("of"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))).alias("first"),
    ), "copies-classes")
    near = materialize(_near_fingerprints(classes, radius), "copies-near")
    tried = materialize(_checked(near, materialize(_grams(near, classes, docs, words), "copies-shingles"), similarity), "copies-checked")
    group = components(tried.where("fit").select("a", "b"))
    # What the fingerprints have joined is not compared again; between their groups the rest is found.
    so_far = classes.join(group, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("component", "class"))
    found = materialize(_candidates(so_far, similarity).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "copies-links")
    late = materialize(_checked(found, materialize(_grams(found, classes, docs, words), "copies-shingles"), similarity), "copies-checked")
    checked = tried.unionByName(late)
    group = joined(group, late.where("fit"))
    more = _candidates(_unlinked(checked, classes, group), similarity, every=True).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = materialize(more, "copies-links")
    if not more.isEmpty():
        late = _checked(more, materialize(_grams(more, classes, docs, words), "copies-shingles"), similarity)
        group = joined(group, materialize(late.where("fit").select("a", "b"), "copies-checked"))
    return rows, classes, group


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """One row per different (doc_id, row_hash), the xxhash64 of its text: its class
    and the group of its class."""
    rows, _, group = _groups(docs, words, similarity, radius)
    named = rows.select("doc_id", "row_hash", "class").distinct().join(group, F.col("class") == F.col("node"), "left")
    return named.select("doc_id", "row_hash", "class", F.coalesce("component", "class").alias("group"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of `docs` without near-copies: of each group the one with the
    smallest doc_id stays (a null one last), and one of its equal rows."""
    _, classes, group = _groups(docs, words, similarity, radius)
    found = classes.select("class", "first").join(group, F.col("class") == F.col("node"), "left")
    kept = found.groupBy(F.coalesce("component", "class")).agg(F.min("first").alias("kept")).select(
        F.col("kept.no_id").alias("__no_id"), F.coalesce("kept.__id", F.lit(0)).alias("__id"), F.col("kept.__hash").alias("__hash")
    )
    at = docs["doc_id"].cast("long")
    own = docs.withColumns({"__no_id": at.isNull(), "__id": F.coalesce(at, F.lit(0)), "__hash": F.xxhash64(docs["text"])})
    # Plain equal keys, the same for both steps, so that the texts are shuffled and sorted once.
    same = ["__no_id", "__id", "__hash"]
    return own.join(kept, same).dropDuplicates(same).select(*[docs[c] for c in docs.columns])
