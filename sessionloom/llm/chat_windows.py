"""Operator 5: conversations as budgeted windows of formatted turns.

Every turn costs a quarter of its characters plus TURN_COST tokens. Prefix sums of
these costs, taken in buckets so that a long conversation is spread over tasks,
place each turn on the token line of its conversation, which is cut into cells of
`fresh` tokens. The turns that lie inside one cell make a window; a turn that
crosses a border is a window of its own. So windows are spans of whole turns and
keep the budget unless a single turn exceeds it. Every window after the first
repeats the system turn and, before its own turns, the turns of the last `history`
tokens before it. Repeated turns are context: only the window's own assistant
texts are under the loss mask, so every target counts once.

Text form, with control strings:

    <s> ( [TURN] role [TEXT] text </s> )*

Control strings inside roles and texts are replaced by U+241B and a digit, and
U+241B by itself and 0; nothing else is changed, and `unescaped` reverses it.

Cases: a null text or role counts as empty; rows with one turn number are ordered
by role, then text, and repeated rows are turns of their own; a null turn number
sorts first; rows with a null conv_id make one conversation; an empty table gives
an empty result; other columns are ignored. The first turn with role `system` is
the system turn; windows before it do not repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.prefix import prefix_sums

BOS, EOS, TURN, TEXT = "<s>", "</s>", "[TURN]", "[TEXT]"
CONTROL = (BOS, EOS, TURN, TEXT, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
TURN_COST = 4
BUCKET_TURNS = 2048
ID = ["conv_id", "window"]


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    text = _replace(text, ESCAPE, ESCAPE + "0")
    for i, control in enumerate(CONTROL, 1):
        text = _replace(text, control, f"{ESCAPE}{i}")
    return text


def unescaped(text: Column) -> Column:
    for i, control in enumerate(CONTROL, 1):
        text = _replace(text, f"{ESCAPE}{i}", control)
    return _replace(text, ESCAPE + "0", ESCAPE)


def placed(turns: DataFrame, fresh: int) -> DataFrame:
    """Turns with their escaped role and text, number `seq`, token span and window."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("plain_role"), F.coalesce("text", F.lit("")).alias("plain_text"),
    ).withColumns({
        "tokens": (F.ceil(F.char_length("plain_text") / 4) + TURN_COST).cast("long"), "one": F.lit(1).cast("long"),
        "bucket": F.floor(F.coalesce("turn", F.lit(-1)) / BUCKET_TURNS),
    })
    order = ["turn", "plain_role", "plain_text"]
    sums = prefix_sums(rows, ["conv_id"], ["bucket"], order, {"seq": "one", "start": "tokens"})
    stop = F.col("start") + F.col("tokens")
    first, last = F.floor(F.col("start") / fresh), F.floor((stop - 1) / fresh)
    return sums.select(
        "conv_id", "seq", "start", stop.alias("stop"), (2 * first + (last > first).cast("long")).alias("window"),
        escaped(F.col("plain_role")).alias("role"), escaped(F.col("plain_text")).alias("text"),
    )


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & a[c].eqNullSafe(b[c])
    return found


def windows(turns: DataFrame, fresh: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window (ascending), n_context, tokens, formatted, and the loss mask
    as an array of (start, stop) characters of `formatted`."""
    if not 0 <= history <= fresh:
        raise ValueError("history must lie between 0 and fresh")
    rows = placed(turns, fresh)
    spans = rows.groupBy(*ID).agg(F.min("start").alias("begin"), F.min("seq").alias("first_seq"))
    is_system = F.col("role") == "system"
    piece = lambda new, lead: F.struct(F.lit(lead).alias("lead"), "seq", F.lit(new).alias("new"), "role", "text", (F.col("stop") - F.col("start")).alias("tokens"))
    system = rows.where(is_system).groupBy("conv_id").agg(F.min(piece(False, 0)).alias("piece"))

    own = rows.select(*ID, piece(True, 1).alias("piece"))
    # A turn can be history of windows that begin at most `history` tokens after its start.
    reach = F.sequence(2 * F.floor(F.col("stop") / fresh), 2 * F.floor((F.col("start") + history) / fresh) + 1)
    before = (
        rows.where(F.col("stop") - F.col("start") <= history)
        .select("conv_id", "seq", "start", F.explode(F.filter(reach, lambda w: w > F.col("window"))).alias("window"), piece(False, 1).alias("piece"))
    )
    past = before.join(spans, _same(before, spans, ID)).where(F.col("start") >= F.col("begin") - history)
    past = past.select(before["conv_id"], before["window"], "piece")
    past = past.join(system.select(F.col("conv_id").alias("c"), F.col("piece.seq").alias("s")), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    past = past.where(F.col("s").isNull() | (F.col("s") != F.col("piece.seq"))).select(*ID, "piece")
    kept = spans.join(system, _same(spans, system, ["conv_id"])).where(F.col("first_seq") > F.col("piece.seq"))
    kept = kept.select(spans["conv_id"], "window", "piece")

    joined = own.union(past).union(kept).groupBy(*ID).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    head = lambda p: F.concat(F.lit(TURN), p["role"], F.lit(TEXT))
    length = lambda c: F.char_length(c).cast("long")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    masked = F.aggregate(
        "pieces", F.struct(F.lit(len(BOS)).cast("long").alias("at"), none.alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + length(head(p)) + length(p["text"]) + len(EOS)).alias("at"),
            F.when(
                p["new"] & (p["role"] == "assistant"),
                F.concat(acc["mask"], F.array(F.struct(
                    (acc["at"] + length(head(p))).alias("start"), (acc["at"] + length(head(p)) + length(p["text"])).alias("stop")))),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return joined.select(
        *ID,
        F.size(F.filter("pieces", lambda p: ~p["new"])).cast("long").alias("n_context"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("tokens"),
        F.concat(F.lit(BOS), F.array_join(F.transform("pieces", lambda p: F.concat(head(p), p["text"], F.lit(EOS))), "")).alias("formatted"),
        masked.alias("loss_mask"),
    )


def parsed(formatted: DataFrame) -> DataFrame:
    """conv_id, window, the window's own turns (role, text) and the texts under its
    loss mask, unescaped, read from `formatted` alone."""
    body = F.expr(f"substring(formatted, {len(BOS) + 1})")
    parts = F.split(body, r"\Q" + EOS + r"\E", -1)
    own = F.slice(parts, F.col("n_context").cast("int") + 1, F.greatest(F.size(parts) - 1 - F.col("n_context").cast("int"), F.lit(0)))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(p, TEXT, 1).substr(F.lit(len(TURN) + 1), F.char_length(p))).alias("role"),
        unescaped(F.substring_index(p, TEXT, -1)).alias("text"))
    return formatted.select(
        *ID, F.transform(own, turn).alias("turns"),
        F.transform("loss_mask", lambda m: unescaped(F.substr("formatted", (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))).alias("targets"),
        F.char_length("formatted").cast("long").alias("chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation from its parsed windows."""
    per_window = read.select(
        *ID, F.size("turns").cast("long").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
    )
    parts = F.array_sort(F.collect_list(F.struct("window", "turns", "loss")))
    whole = per_window.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts"))
    text = lambda f: F.array_join(F.transform("parts", lambda p: p[f]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.char_length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
