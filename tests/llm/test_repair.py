"""Operator 11 against a plain search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from sessionloom.llm import repair

LEGAL = {"su", "ua", "au"}


def plain_edits(rows):
    """Cheapest (cost, initials, kept rows) by uniform-cost search over (cost, initials)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        role, nxt = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*out, (role, ""))))
        if i < len(rows):
            given, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, nxt, (*out, (role, text))))
                to = {"s": 1, "u": 2, "a": 3}.get(given[:1])
                if to and (to == 1 and state == 0 or to == 2 and state != 2 or to == 3 and state == 2):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*out, (given, text))))


def plain(conversations):
    groups = defaultdict(list)
    for conv, turn, role, text in conversations:
        rows = groups[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        cost, audit, kept = plain_edits([(r[1], r[2], f) for r, f in zip(rows, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     illegal, cost, audit, digest)
    return out


def sample(seed, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "open end", "", " \t", "é 日本.", None, "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        n = r.choice([1, 2, 3, 5, longest])
        for turn in range(n):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
            rows.append((conv, turn if r.random() < 0.95 else None, role, r.choice(texts) if r.random() < 0.5 else f"t {r.random()}."))
    return rows + rows[:7]


@pytest.mark.parametrize("block", [128, 3])
def test_repair_equals_plain_search(spark, block):
    rows = sample(block, 40)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS block", "0 AS cost", "1 AS first")
    found = {r[0]: tuple(r[1:]) for r in repair.repaired(repair.damaged(given), given, block).collect()}
    assert found == plain(rows)


def test_conversation_without_rows_and_empty_table(spark):
    shape = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], shape)
    assert repair.repaired(repair.damaged(none), none).collect() == []
    given = spark.createDataFrame([(7, 1, "user", "Hi.")], shape)
    assert [tuple(r) for r in repair.repaired(none, given).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(1, n, r.choice(["user", "assistant"]), r.choice(["same.", f"a {n}.", f"b {n}"])) for n in range(3000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r[0]: tuple(r[1:]) for r in repair.repaired(repair.damaged(given), given).collect()}
    assert found == plain(rows)


def test_query_equals_plain_search(spark):
    from sessionloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
             for r in QUERIES["op11_ida_repair"](spark, sf).collect()}
    assert found == plain(rows)
