"""Operators 2, 3, 5, 7, 9 and the pipeline against plain versions, on cases of all kinds."""

import hashlib
import math
import os
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import chat_windows, components, mixing, nn_descent, simhash_vp, url_filter
from sessionloom.llm.queries import QUERIES
from tests.llm.helpers import LONG, TEXTS, documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# SimHash

def plain_groups(items, linked):
    up = {x: x for x in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                up[root(a)] = root(b)
    return {x: root(x) for x in items}


def plain_fingerprint(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = documents(spark)
    rows = simhash_vp.near_duplicates(docs, 3, 2).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    fps = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    group = plain_groups(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least.get(group[fps[r.doc_id]])
    assert simhash_vp.near_duplicates(docs.limit(0), 3, 2).collect() == []


def test_simhash_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op7_simhash_components"](spark, SF).collect()
    fps = {r.doc_id: plain_fingerprint(r.text or "", 3) for r in docs.collect()}
    group = plain_groups(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: math.inf)
    for i, f in fps.items():
        least[group[f]] = min(least[group[f]], i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", least[group[f]]) for i, f in fps.items()}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5), st.integers(0, 4))
def test_tree_shards_lose_no_link(seed, radius, depth):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(5), np.arange(300, dtype=np.uint64)]))
    want = simhash_vp.Groups(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(simhash_vp.distance(fps, fps[i]) <= radius)
        want.join(np.full(len(j), i), j)
    row, shard = simhash_vp.Tree(rng.choice(fps, 60, replace=False), depth).shards(fps, radius)
    got = simhash_vp.Groups(len(fps))
    for s in np.unique(shard):
        at = row[shard == s]
        got.join(at, at[simhash_vp.linked(fps[at], radius)])
    assert (got.roots() == want.roots()).all()


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "SHARD_ROWS", 32)
    monkeypatch.setattr(simhash_vp, "SAMPLE_PER_SHARD", 8)
    values = [(i * 2654435761) % 2**40 << 3 | i % 3 for i in range(400)]
    pairs = simhash_vp.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2)
    got = {r.node: r.component for r in components.components(pairs).collect()}
    want = plain_groups(sorted(values), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {v: got.get(v, v) for v in values} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200), (300, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 0, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_copies(spark):
    w = [f"k{i}" for i in range(200)]
    other = [w[:i] + ["zz"] + w[i + 1:] for i in (20, 100)]
    far = ["q" if i % 6 == 0 else x for i, x in enumerate(w)]
    texts = [*TEXTS, *map(" ".join, [w, *other, far]), " ".join(w).upper(), None, " "]
    docs = documents(spark, texts)
    left = simhash_vp.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [0, 3, 4, None, 6, 8, 9, 10, 11, 12, 15]))
    assert simhash_vp.one_of_each(docs.limit(0)).collect() == []


def test_near_copy_groups_equal_brute_force(spark):
    rng, texts = np.random.default_rng(4), []
    for family in range(6):
        base = [f"f{family}w{i}" for i in rng.integers(0, 80, 120)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 6)):
                w[at] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [frozenset(simhash_vp.shingle_hashes(t, 5)) for t in texts]
    want = plain_groups(range(len(texts)), lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]))
    got = defaultdict(set)
    for r in simhash_vp.near_copies(docs).collect():
        got[r.group].add(r.doc_id)
    expected = defaultdict(set)
    for i, g in want.items():
        expected[g].add(i)
    assert len(expected) > 6
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """Without the shards of smallest hashes the trees still find texts of near fingerprints."""
    w = [f"v{i}" for i in range(3000)]
    other = w[:1500] + ["zz"] + w[1501:]
    texts = [" ".join(w), " ".join(other), " ".join(w[::-1]), ". " * 500 + "one two three", ". " * 500 + "four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash_vp.majority(simhash_vp.shingle_hashes(t, 5)) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and fps[3] == fps[4]
    monkeypatch.setattr(simhash_vp, "_candidates", lambda rows, similarity, every=False: spark.createDataFrame([], "a long, b long"))
    # The last two have one fingerprint, as most of their shingles are one, and unlike sets.
    assert sorted(r.doc_id for r in simhash_vp.one_of_each(docs).collect()) == [0, 2, 3, 4]


def copy_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in simhash_vp.near_copies(docs).collect():
        got[r.group].add(r.doc_id)
    return sorted(map(sorted, got.values()))


def test_texts_of_near_copies_are_shuffled_once(spark):
    rows = [(i if i % 9 else None, f"word{i} " * (i + 1)) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = simhash_vp.one_of_each(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        found = left.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    assert sum("Exchange hashpartitioning(__no_id" in x for x in initial.splitlines()) == 2
    assert len({(r.doc_id, r.text) for r in found}) == len(found)


def test_wanted_texts_of_few_classes_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g {i}") for i in range(50)], "doc_id long, text string")
    classes = simhash_vp._described(docs, 5).select("class", F.struct("doc_id", "row_hash").alias("of"))
    one, two = (r["class"] for r in classes.orderBy("of.doc_id").limit(2).collect())
    links = spark.createDataFrame([(one, two)], "a long, b long")
    grams = simhash_vp._grams(links, classes, docs, 5)
    plan = grams._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["class"] for r in grams.collect()} == {one, two}


def test_components_go_on_from_what_is_connected(spark, monkeypatch):
    group = components.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (70, 70)], "a long, b long"))
    more = spark.createDataFrame([(51, 20, "x"), (90, 91, "y")], "a long, b long, other string")
    kept, files = components.materialize, []
    monkeypatch.setattr(components, "materialize", lambda df, label: (files.append((out := kept(df, label)).inputFiles()), out)[1])
    got = {r.node: r.component for r in components.joined(group, more).collect()}
    assert got == {**{i: 0 for i in [*range(21), 50, 51]}, 90: 90, 91: 90}
    assert all(len(x) == 1 for x in files[1:])  # few edges, few files


def test_near_copies_with_a_run_of_one_sign(spark):
    texts = []
    for k in range(8):
        w = [f"t{k}w{i}" for i in range(1000)]
        texts += [" ".join(w), " ".join(w[:400] + [".-"[k % 2]] * 150 + w[400:])]
    assert copy_groups(spark, texts) == [[2 * k, 2 * k + 1] for k in range(8)]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 1500), st.integers(0, 300), st.integers(0, 300))
def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(seed, both, one, two):
    rng = np.random.default_rng(seed)
    a, b, c = np.split(np.unique(rng.integers(0, 2**64, both + one + two, dtype=np.uint64)), [both, both + one])
    codes = sorted((simhash_vp._sketch(np.concatenate([a, z])) for z in (b, c)), key=len)
    assert simhash_vp._Sketches(codes).differ(0, np.array([1]))[0] <= one + two


def test_sketches_tell_long_texts_with_half_in_common_apart():
    rng = np.random.default_rng(3)
    same = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    codes = [simhash_vp._sketch(np.concatenate([same, rng.integers(0, 2**64, 1000, dtype=np.uint64)])) for _ in range(50)]
    pairs = simhash_vp._close(np.full(50, 2000), simhash_vp._Sketches(codes), np.arange(50), None, 0.8, True)
    assert sum(len(i) for i, _ in pairs) == 0


def test_large_shards_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "SHARD_BLOCK", 16)
    rng, texts = np.random.default_rng(6), []
    same = [f"same{i}" for i in range(100)]
    for k in range(60):  # a long passage in common, a tail of their own and, for some, a copy
        w = same + [f"own{k}w{i}" for i in range(60)]
        texts.append(" ".join(w))
        if k % 3 == 0:
            w[int(rng.integers(110, 150))] = "other"
            texts.append(" ".join(w))
    base = [f"b{i}" for i in range(200)]
    texts += [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(0, 200, 2)]
    grams = [frozenset(simhash_vp.shingle_hashes(t, 5)) for t in texts]
    want = plain_groups(range(len(texts)), lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]))
    expected = defaultdict(set)
    for i, g in want.items():
        expected[g].add(i)
    assert copy_groups(spark, texts) == sorted(map(sorted, expected.values()))
    rows = spark.createDataFrame([(i, i, b"", [7]) for i in range(160)], "class long, n long, sketch binary, keys array<long>")
    sizes = [r["count"] for r in simhash_vp._dealt(rows.withColumn("group", F.col("class"))).groupBy("shard").count().collect()]
    assert len(sizes) == 55 and max(sizes) <= 64


# Mixing

def test_mixing_schedule(spark):
    docs = documents(spark, [*TEXTS, *[f"a b c d e {i}" for i in range(300)]])
    plan = mixing.schedule(docs, repeats=3.0, block_tokens=500).collect()
    tokens, budget, read = defaultdict(int), defaultdict(int), defaultdict(int)
    units = {(r.source, r.doc_id, r.n_tokens): r["rows"] for r in mixing.units(docs).collect()}
    for (s, _, n), m in units.items():
        tokens[s] += n * m
    seen = set()
    for r in plan:
        key = (r.source, r.doc_id, r.n_tokens)
        assert units[key] == r["rows"] and (key, r["pass"]) not in seen
        seen.add((key, r["pass"]))
        read[r.source] += r.n_tokens * r["rows"]
        budget[r.source] = max(budget[r.source], r["pass"])
    assert set(units) == {k for k, _ in seen}  # without a budget every document is read
    assert all(1 <= read[s] / tokens[s] <= 3.0 + max(n for (t, _, n) in units if t == s) / tokens[s] for s in tokens)
    places = defaultdict(list)
    for r in plan:
        places[r.block].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values()) and len(places) > 2
    assert mixing.schedule(docs.limit(0), repeats=2.0).collect() == []


def test_mixing_targets(spark):
    shares = spark.createDataFrame([(f"s{i}", 10 * 3**i) for i in range(6)], "source string, tokens long")
    p = np.array([3.0**i for i in range(6)])
    p /= p.sum()
    a, _ = mixing.exponent(shares, 3640, entropy=0.9, repeats=None)
    h = lambda a: -(p**a / (p**a).sum() * np.log(p**a / (p**a).sum())).sum() / math.log(6)
    assert h(a) >= 0.9 > h(a + 0.0002)
    a, _ = mixing.exponent(shares, 3640, entropy=None, repeats=4.0)
    r = lambda a: (p**(a - 1) / (p**a).sum()).max()
    assert r(a) <= 4.0 < r(a - 0.0002)
    one = spark.createDataFrame([("only", 7)], "source string, tokens long")
    assert mixing.exponent(one, None, entropy=None, repeats=2.0) == (0.0, 7)
    with pytest.raises(ValueError):
        mixing.exponent(one, None, None, None)


def test_mixed_rows(spark):
    docs = documents(spark, [*TEXTS, "t u v"])
    out = mixing.mixed(docs, repeats=2.0)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert set(got) == {r.doc_id for r in docs.collect()} and all(v <= 4 for v in got.values())


# Nearest neighbours

def plain_nearest(rows, asked, count):
    ids = sorted({i for i, _ in rows})
    v = {i: np.array(x) for i, x in rows}
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b)))
    return {q: sorted((-round(cos(v[q], v[i]), 12), i) for i in ids if i != q)[:count] for q in asked}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 900)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(3000, [0.5 * x for x in rows[0][1]])]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, []), (2006, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, "n", 0) for i, x in [*rows, *odd, rows[7]]], "vec_id long, embedding array<double>, node string, rank int")
    got = defaultdict(list)
    for r in nn_descent.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((-round(r.score, 12), r.vec_id, r["rank"]))
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert set(got) == set(want) and all([x[2] for x in sorted(v, key=lambda x: x[2])] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [x[1] for x in sorted(got[1000], key=lambda x: x[2])] == [1, 1001, 1002, 1003, 1004]
    assert nn_descent.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_recall_in_a_tight_group(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    v = np.concatenate([one + 1e-3 * rng.standard_normal((3000, 64)), rng.standard_normal((1000, 64))])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nn_descent.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        near = -((u - u[q]) ** 2).sum(1)
        near[q] = -9
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60, hits / 300


def test_few_candidates(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nn_descent.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 0.707107), (50, 2, 2, 0.0)]


def test_nearly_equal_doubles_are_told_apart(spark):
    rows = [(i, [1.0, 1 + 1e-9 * (21 - i)]) for i in range(1, 21)] + [(50, [1.0, 0.0]), (60, [2.0, 2 + 2e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nn_descent.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    exact = {i: x / math.sqrt(x * x + y * y) for i, (x, y) in rows}
    assert [i for i, _ in got] == [20, 60, 19, 18, 17]
    assert all(abs(score - exact[i]) < 1e-15 for i, score in got)


def test_recall_on_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = defaultdict(set)
    for r in QUERIES["op3_nn_descent"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_rows_between_steps_are_blocks(spark, monkeypatch):
    """What goes from one step to the next is a row for each two blocks, not one for each pair of nodes."""
    written = []

    def counted(df, *more, keep=nn_descent.materialize):
        out = keep(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(nn_descent, "materialize", counted)
    v = np.random.default_rng(5).standard_normal((1500, 16))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    rows = nn_descent.search(df, F.col("vec_id") % 50 == 0).collect()
    want = plain_nearest([(i, x) for i, x in enumerate(v.tolist())], range(0, 1500, 50), 5)
    assert len(rows) == 5 * 30 and sum(r.vec_id in {i for _, i in want[r.query_id]} for r in rows) >= 0.98 * 150
    assert sum(written) < 6 * 1500, written


def test_blocks_do_not_follow_partitions(spark):
    rows = [(i, [float(i % 7), 1.0 + i]) for i in range(600, 0, -1)] + [(1000 + i, [float(i % 7), 1.0 + i]) for i in range(9)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        store = nn_descent.stored(nn_descent.usable(given, "vec_id", "embedding"), F.col("vec_id") == 5, "f8")
        made = sorted(store.rows.collect(), key=lambda r: r.block)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [np.frombuffer(r.ids, np.int64).tolist() for r in made]
    assert [len(x) for x in ids] == [512, 89] and store.blocks == 2 and sum(ids, []) == [*range(1, 601), 1000]
    flags, data = (np.concatenate([np.frombuffer(r[c], t) for r in made]) for c, t in (("flags", np.uint8), ("data", np.float64)))
    assert [i + 1 for i in np.flatnonzero(flags & 1)] == [5] and [i + 1 for i in np.flatnonzero(flags & 2)] == [*range(1, 9)]
    assert data.reshape(-1, 2).tolist() == [[float(i % 7), 1.0 + i] for i in [*range(1, 601), 0]]


@pytest.mark.parametrize("cell", [32, 1])
def test_many_blocks_waves_and_a_large_leaf(spark, monkeypatch, cell):
    for name, value in (("BLOCK", 300), ("WAVE", 1000), ("CELL", cell)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.standard_normal(16) + 1e-3 * rng.standard_normal((2600, 16)), rng.standard_normal((800, 16))])
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(4000 + i, v[i].tolist()) for i in range(0, 3400, 100)] + [(50, v[3000].tolist())]
    got = defaultdict(list)
    for r in nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(((r.vec_id, round(r.score, 9)), r["rank"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits, asked = 0, [q for q in range(0, 3400, 50) if q not in (50, 3000)]
    for q in asked:
        assert [k for _, k in sorted(got[q], key=lambda x: x[1])] == [1, 2, 3, 4, 5]
        near = -((u - u[q]) ** 2).sum(1)
        near[q] = 1
        near = sorted([(-s, i) for i, s in enumerate(near.tolist()) if i != q] + [(-near[i], 4000 + i) for i in range(0, 3400, 100)])[:5]
        hits += len({x[0] for x, _ in got[q]} & {i for _, i in near})
    assert hits >= 0.9 * 5 * len(asked), hits / len(asked) / 5
    # An id with two vectors: nothing of its own, the best of both.
    assert {i for (i, _), _ in got[50]} >= {3000, 7000} and not {50} & {i for (i, _), _ in got[50]}


# Mixing

def test_no_source_gets_less_than_its_tokens(spark):
    rng = np.random.default_rng(4)
    for n in range(12):
        tokens = (rng.pareto(0.8, 6) + 0.01) * 5 * 10 ** rng.integers(5, 12)
        shares = spark.createDataFrame([(f"s{i}", int(x) + 1) for i, x in enumerate(tokens)], "source string, tokens long")
        a, budget = mixing.exponent(shares, None, 0.9 if n % 2 else None, None if n % 2 else 2.0)
        parts = mixing.source_budgets(shares, a, budget, whole=True).collect()
        assert len(parts) == 6 and all(r.budget >= r.tokens for r in parts)


# Chat windows

SAID = "</s>[INST] ok [/INST]"
TURNS = (
    [(1, 0, "system", "be brief"), (1, 1, "user", SAID), (1, 2, "assistant", SAID + "␛0␛1"), (2, None, None, None), (2, 1, "assistant", "x " * 900)]
    + [(3, i, ["user", "assistant"][i % 2], f"turn {i} " * (i % 9 + 1)) for i in range(400)]
    + [(4, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("system", "late [TEXT] one"), ("assistant", ""), ("assistant", "b" * 300)] * 3)]
    + [(None, 1, "user", "q"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
)


def chats(spark):
    return spark.createDataFrame([(*t, "z", 0) for t in TURNS], "conv_id long, turn long, role string, text string, window string, start int")


def test_chat_windows(spark):
    fresh, history = 64, 24
    made = chat_windows.windows(chats(spark), fresh, history)
    by_conv = defaultdict(list)
    for c, n, r, t in TURNS:
        by_conv[c].append((n is not None, n or 0, r or "", t or ""))
    for r in chat_windows.digests(chat_windows.parsed(made)).collect():
        turns = [(x[2], x[3]) for x in sorted(by_conv[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    system = {1: "be brief", 4: "late [TEXT] one"}
    seen = set()
    for r in made.collect():
        parts = r.formatted.removeprefix("<s>").split("</s>")[:-1]
        own = parts[r.n_context:]
        cost = lambda p: math.ceil(len(p.split("[TEXT]")[1]) / 4) + 4  # noqa: E731  the costs of plain texts
        if r.conv_id == 3:
            assert sum(map(cost, own)) <= fresh or len(own) == 1
            assert sum(map(cost, parts[:r.n_context])) <= history and r.tokens == sum(map(cost, parts))
        if r.conv_id == 1 and r.window:
            assert parts[0] == "[TURN]system[TEXT]be brief"
        for start, stop in r.loss_mask:
            assert r.formatted[stop:stop + 4] == "</s>" and r.formatted[:start].endswith("[TURN]assistant[TEXT]")
        seen.add(r.conv_id)
    assert seen == set(by_conv) and len(system) == 2
    assert chat_windows.windows(chats(spark).limit(0)).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([*chat_windows.CONTROL, "␛", "0", "1", "9", "[", "<", "a", "\n"]), max_size=12).map("".join))
def test_escapes(spark, text):
    row = spark.range(1).select(chat_windows.escaped(F.lit(text)).alias("e"), chat_windows.unescaped(chat_windows.escaped(F.lit(text))).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in chat_windows.CONTROL)


# URL filter

def test_url_rules_and_model(spark):
    urls = [
        None, "", "no scheme/x", "http://WWW.Example.COM/en/1?q#f", "http://example.com/en/1", "https://a.example.com/en/", "http://example.com/fr",
        "x://b.net/es/1://c", "http://net/fr/9", "http://internet/fr/9", "http://example.org", "http://Éx.example.org/É?x", "http://spam-farm.example.org/en/1",
        "https://www.library.example.org/catalogue/19", "http://h.example.org/" + "ab/" * 20_000, "http://com", "http://x.com/", "http://x.com/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    weights, intercept = url_filter.fit(url_filter.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judged(pages, "page_id", url_filter.RULES, weights, intercept).collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.score > 0 else "allow")
        grams = {m + t[k:k + n] for m, t in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")) for n in (3, 4, 5) for k in range(len(t) - n + 1)}
        slots = {xxhash.xxh64_intdigest(g.encode(), 42) for g in grams}
        slots = {(s - 2**64 if s >= 2**63 else s) % url_filter.DIMS for s in slots}
        assert abs(r.score - intercept - sum(weights[s] for s in slots)) < 1e-9
    assert got[12].verdict == "block" and got[13].verdict == "allow" and got[0].verdict == "allow"
    labels = {(u, v) for v, us in ((1, url_filter.UNWANTED), (0, url_filter.ORDINARY)) for u in us}
    known = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(sorted(labels))], "page_id long, url string")
    scores = {r.page_id: r.score for r in url_filter.judged(known, "page_id", url_filter.RULES, weights, intercept).collect()}
    assert all((scores[i] > 0) == bool(v) for i, (_, v) in enumerate(sorted(labels)))
    assert url_filter.judged(pages.limit(0), "page_id", url_filter.RULES, weights, intercept).collect() == []


# Pipeline

def test_pipeline_on_odd_rows(spark):
    docs = documents(spark, [*TEXTS, LONG.replace("w1", "v1"), "write to x@y.example.org about " + " ".join(f"m{i}" for i in range(90))])
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    rows = docs.collect()
    assert {11, 12, 13} >= {r.doc_id for r in rows} and 13 in {r.doc_id for r in rows}
    empty = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_pipeline_stages_are_the_operators(spark):
    kept = {r.doc_id for r in QUERIES["op10_suffix_repeats"](spark, SF).where("kept").select("doc_id").collect()}
    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    grams = {r.doc_id: frozenset(simhash_vp.shingle_hashes(r.text, 5)) for r in docs.collect()}
    group = plain_groups(sorted(grams), lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]))
    left = corpus_pipeline.near_copies(spark, docs, SF)
    assert {r.doc_id for r in left.select("doc_id").collect()} == set(group.values())
