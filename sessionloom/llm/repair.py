"""Operator 11: repair of conversation structure by iterative-deepening A*.

A conversation's rows, in order of turn, are edited until the role initials read
`(s?(ua)+)?`: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank
and duplicate rows), Insert an empty user or assistant row anywhere (2); a truncated row
that stays adds 1. Among the cheapest edits the ASCII-least initials win. A search
state is (row, what the grammar has read); in each state an edit's initial leads to one
successor only. The search goes depth first in ASCII order (D, I, K, R) under a bound on
cost plus an admissible estimate of the rest; the bound rises to the least sum that
exceeded it. A table keeps, for each state, the largest remaining budget that failed, so
no state is searched twice with as little. The first accepting path is the answer.

Long conversations are cut into blocks of BLOCK rows. Equal rows are counted before
they are sorted, so that the global order by (conv_id, turn, role, text) deals any
conversation to many tasks. A block's costs between grammar states (a 4 x 4 matrix in
min-plus algebra) give the exact cost to go at its end; each block is searched by
itself for every state it may begin in, and only the found edits are strung together.
The digest of a conversation is one sequential hash, so its blocks' rows pass through
one task in order, of which only the hash and the initials stay in memory.

Faults: each row counts for its first of blank (no character but space, U+0009 to
U+000D), duplicate (role and text seen earlier), truncated (last such character none of
`.!?`).

Cases: a null role or text is one space; a null turn sorts first; a null conv_id is a
conversation like others; rows of one turn are ordered by role and text (as UTF-8
bytes), equal rows are duplicates of the first; an empty table gives an empty result; a
conversation without rows is repaired to nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import _arrow, materialize, slices

BLANK, DUPLICATE, TRUNCATED, FINE = 1, 2, 3, 0
#: Rows of a block.
BLOCK = 128
#: Grammar states: nothing yet, after the system turn, after a user, after an assistant turn.
STATES, START, SYSTEM, USER, ASSISTANT = 4, 0, 1, 2, 3
#: Role that a rerole or an insert must give in each state, and the state after it.
NEED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: State after a kept row by its initial.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Cost to go once all rows are read: accept after nothing or an assistant turn.
AT_END = (0, NEVER, NEVER, 0)
Rows = list[tuple[str, int]]  # initial, fault


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults chosen by crc32(conv_id:turn) % 20."""
    given = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return given.withColumn("k", kind).where("k <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("one")
    ).drop("one")


def steps(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits that are allowed before a row, in ASCII order: initial, cost, rows read, next state."""
    yield "D", 3, 1, state
    yield "I", 2, 0, NEED[state][1]
    if fault not in (BLANK, DUPLICATE):
        late = fault == TRUNCATED
        if (state, initial) in KEEP:
            yield "K", late, 1, KEEP[state, initial]
        yield "R", 2 + late, 1, NEED[state][1]


def least_rest(rows: Rows, ends: tuple[int, ...]) -> list[int]:
    """For each row a lower bound of what it and the rest cost: required deletions,
    truncated rows, roles that no kept row may have."""
    out = [min(ends)]
    for initial, fault in reversed(rows):
        must = 3 if fault in (BLANK, DUPLICATE) else min(3, (fault == TRUNCATED) + 2 * (initial not in ("s", "u", "a")))
        out.append(out[-1] + must)
    return out[::-1]


def search(rows: Rows, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """Initials of the cheapest edits of `rows` from `state`, ASCII-least among equals,
    and the state they end in; `ends` is the cost to go from each state after the rows."""
    n, rest = len(rows), least_rest(rows, ends)
    failed: dict[tuple[int, int], int] = {}
    bound, path = rest[0], []
    while True:
        beyond = NEVER
        # Frames: row, state, cost so far, edits still to try (None: not looked at yet).
        stack: list[list] = [[0, state, 0, None]]
        path.clear()
        while stack:
            row, at, cost, edits = frame = stack[-1]
            if edits is None:
                if row == n and cost + ends[at] <= bound:
                    return "".join(path), at
                if (lost := failed.get((row, at), -1)) >= bound - cost:
                    # The rest costs more than what failed, and costs are whole numbers.
                    beyond, edits = min(beyond, cost + lost + 1), iter(())
                elif row == n:
                    beyond = min(beyond, cost + ends[at])
                    edits = iter((("I", 2, 0, NEED[at][1]),))
                else:
                    edits = steps(*rows[row], at)
                frame[3] = edits
            for name, price, read, after in edits:
                total = cost + price
                if total + rest[row + read] > bound:
                    beyond = min(beyond, total + rest[row + read])
                    continue
                path.append(name)
                stack.append([row + read, after, total, None])
                break
            else:
                failed[row, at] = max(failed.get((row, at), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def matrix(rows: Rows) -> list[int]:
    """Least cost from each state before the rows to each state after them."""
    out = []
    for begin in range(STATES):
        cost = [NEVER] * STATES
        cost[begin] = 0
        for initial, fault in rows:
            cost, new = _inserted(cost), [NEVER] * STATES
            for state in range(STATES):
                for _, price, read, after in steps(initial, fault, state):
                    if read:
                        new[after] = min(new[after], cost[state] + price)
            cost = new
        out += _inserted(cost)
    return out


def _inserted(cost: list[int]) -> list[int]:
    cost = list(cost)
    for _ in range(2):
        for state in range(STATES):
            after = NEED[state][1]
            cost[after] = min(cost[after], cost[state] + 2)
    return cost


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave or make."""
    at = iter(rows)
    for name in audit:
        if name == "D":
            next(at)
            continue
        role, after = NEED[state]
        if name == "I":
            yield role, ""
        else:
            given, text = next(at)
            if name == "K":
                role, after = given, KEEP[state, given[:1]]
            yield role, text
        state = after


def fault_of(text: str, again: bool) -> int:
    last = text.rstrip(" \t\n\x0b\f\r")
    return BLANK if not last else DUPLICATE if again else FINE if last[-1] in ".!?" else TRUNCATED


def repaired(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of `conversations`: what is wrong with its `rows` (conv_id,
    turn, role, text), the cost and initials of the cheapest edits, and the digest of the
    rows after them."""
    found = _strung(_searched(_blocks(rows, block)))
    known = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = known.join(found.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


BLOCKS = (
    "block long, conv_id long, roles array<string>, texts array<string>, faults array<int>, costs array<long>, "
    "illegal long, turns long, first_turn long, last_turn long"
)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ordered rows, numbered in the global order (see BLOCKS)."""
    key = ["conv_id", "turn", "role", "text"]
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    counted = given.groupBy(*key).agg(F.count("*").alias("n"))
    same = counted.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # The first of equal rows: a struct orders nulls first, as turns are ordered.
    firsts = same.groupBy(F.col("conv_id").alias("__c"), F.col("same").alias("__s")).agg(F.min(F.struct("turn")).alias("__f"))
    known = same.join(firsts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("same") == F.col("__s")))
    known = known.select(*key, "n", F.col("turn").eqNullSafe(F.col("__f.turn")).alias("first"))
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in key]
    arrow = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        out: list[dict] = []
        for batch in batches:
            for conv, turn, role, text, n, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for i in range(n):
                    if held and (len(held) == size or held[0][0] != conv):
                        out.append(_block(number, held))
                        number, held = number + 1, []
                    held.append((conv, turn, role, text, not first or i > 0))
                    if len(out) == 200:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
        if held:
            out.append(_block(number, held))
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ordered = known.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(run, BLOCKS), "repair-blocks")


def _block(number: int, held: list[tuple]) -> dict:
    roles, texts = [h[2] for h in held], [h[3] for h in held]
    faults = [fault_of(h[3], h[4]) for h in held]
    turns = {h[1] for h in held} - {None}
    initials = [r[:1] for r in roles]
    return {
        "block": number, "conv_id": held[0][0], "roles": roles, "texts": texts, "faults": faults,
        "costs": matrix(list(zip(initials, faults, strict=True))),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(turns), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
    }


def _by_conversation(blocks: DataFrame, descending: bool = False) -> DataFrame:
    """A conversation's blocks in one task and in order, so that they can be streamed."""
    order = F.col("block").desc() if descending else F.col("block").asc()
    count = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(count, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), order)


def _searched(blocks: DataFrame) -> DataFrame:
    """Blocks with, for each state they may begin in, the initials found, the state after them and the cost."""
    ends = _arrow("block long, first boolean, ends array<long>")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's last block to its first: the cost to go at each block's end."""
        seen, conv, to_go, out = False, None, AT_END, []
        for batch in batches:
            for number, this, costs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not seen or this != conv:
                    if out:
                        out[-1]["first"] = True
                    seen, conv, to_go = True, this, AT_END
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out[:-1], schema=ends)
                    out = out[-1:]
                out.append({"block": number, "first": False, "ends": list(to_go)})
                to_go = tuple(min(min(costs[4 * a + b] + to_go[b] for b in range(STATES)), NEVER) for a in range(STATES))
        if out:
            out[-1]["first"] = True
            yield pa.RecordBatch.from_pylist(out, schema=ends)

    # A block number occurs once; the matrices alone travel here, sixteen numbers for BLOCK rows.
    costs = _by_conversation(blocks.select("block", "conv_id", "costs"), descending=True)
    to_go = costs.mapInArrow(back, "block long, first boolean, ends array<long>").withColumnRenamed("block", "__b")
    shape = f"{BLOCKS}, audits array<string>, exits array<int>, paid array<long>"
    arrow = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = batch.to_pylist()
            for row in out:
                first, after = row.pop("first"), tuple(row.pop("ends"))
                rows = [(r[:1], f) for r, f in zip(row["roles"], row["faults"], strict=True)]
                found = [search(rows, s, after) if not first or s == START else None for s in range(STATES)]
                row["audits"] = [f and f[0] for f in found]
                row["exits"] = [f and f[1] for f in found]
                row["paid"] = [f and paid(rows, f[0], s) for s, f in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    joined = blocks.join(to_go, F.col("block") == F.col("__b")).drop("__b")
    return joined.mapInArrow(run, shape)


def paid(rows: Rows, audit: str, state: int) -> int:
    total, at = 0, 0
    for name in audit:
        row = rows[at] if name != "I" else ("", FINE)
        price, read, state = next(s[1:] for s in steps(*row, state) if s[0] == name)
        total, at = total + price, at + read
    return total


def _strung(searched: DataFrame) -> DataFrame:
    """The blocks of each conversation strung together."""
    shape = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, repaired_sha256 string")
    arrow = _arrow(shape)

    class Whole:
        def __init__(self, conv: int | None):
            self.conv, self.state, self.cost, self.audit, self.hash, self.any = conv, START, 0, [], hashlib.sha256(), False
            self.faults, self.illegal, self.last, self.turns, self.low, self.high = [0, 0, 0, 0], 0, None, 0, None, None

        def add(self, row: dict) -> None:
            state = self.state
            audit, after = row["audits"][state], row["exits"][state]
            self.audit.append(audit)
            self.cost += row["paid"][state]
            for role, text in edited(list(zip(row["roles"], row["texts"], strict=True)), audit, state):
                self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                self.any = True
            self.state = after
            for f in row["faults"]:
                self.faults[f] += 1
            self.illegal += row["illegal"]
            if self.last is not None:
                self.illegal += self.last[:1] + row["roles"][0][:1] not in LEGAL
            self.last = row["roles"][-1]
            if row["turns"]:
                self.turns += row["turns"] - (row["first_turn"] == self.high)
                self.low = row["first_turn"] if self.low is None else self.low
                self.high = row["last_turn"]

        def out(self) -> dict:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return {"conv_id": self.conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                    "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost,
                    "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if whole is None or whole.conv != row["conv_id"]:
                    if whole is not None:
                        done.append(whole.out())
                    whole = Whole(row["conv_id"])
                whole.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if whole is not None:
            yield pa.RecordBatch.from_pylist([whole.out()], schema=arrow)

    return _by_conversation(searched).mapInArrow(run, shape)

