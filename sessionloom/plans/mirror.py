"""Edited mirrors: parse them back, merge the edits, audit protected blocks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.text import WS, full_trim
from sessionloom.plans.packets import PacketSet
from sessionloom.plans.render import CLOSE, OPEN

BLOCK = rf"(?s){re.escape(OPEN)}[{WS}]*(.*?)[{WS}]*{re.escape(CLOSE)}"
FIELDS = {"objective": "objective", "current state": "current_state", "next action": "next_action"}
LISTS = {"acceptance criteria": "criteria", "constraints": "constraints",
         "open questions": "questions"}
ITEM_ID = rf"<!--[{WS}]*{K.MARKER}:id=([a-z0-9][a-z0-9._-]{{1,127}})[{WS}]*-->"


def mirror_lines(mirrors: DataFrame) -> DataFrame:
    """Lines after the title with the heading they stand under. The lines of one
    mirror come from one text value, which bounds each window."""
    text = F.regexp_replace("markdown", BLOCK, "")
    rows = mirrors.select("packet_id", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    whole = Window.partitionBy("packet_id")
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.regexp_extract("line", rf"\A#[{WS}]+(.+)\z", 1)
    head = F.regexp_extract("line", rf"\A##[{WS}]+(.+?)[{WS}]*\z", 1)
    return (
        rows.withColumn("title_pos", F.min(F.when(title != "", F.col("pos"))).over(whole))
        .where(F.col("pos") >= F.col("title_pos"))
        .withColumn("title", F.when(F.col("pos") == F.col("title_pos"), full_trim(title)))
        .withColumn("is_head", (head != "") & (F.col("pos") > F.col("title_pos")))
        .withColumn("heading", F.last(F.when(F.col("is_head"), F.lower(full_trim(head))),
                                      ignorenulls=True).over(so_far))
        .select("packet_id", "pos", "line", "title", "is_head", "heading")
    )


def edited_fields(lines: DataFrame) -> DataFrame:
    """`packet_id, field, value` of the title and the narrative sections."""
    titles = lines.where("title IS NOT NULL").select(
        "packet_id", F.lit("title").alias("field"), F.col("title").alias("value")
    )
    names = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    body = lines.where(F.col("heading").isin(list(FIELDS)) & ~F.col("is_head"))
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return titles.unionByName(
        body.groupBy("packet_id", "heading").agg(full_trim(joined).alias("value")).select(
            "packet_id", names[F.col("heading")].alias("field"), "value")
    )


def field_edits(packets: DataFrame, lines: DataFrame) -> DataFrame:
    """Title and narrative fields whose text was changed to another, filled text."""
    now = packets.select("packet_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("current"))
        for f in ("title", *FIELDS.values())])))
    return edited_fields(lines).join(now, ["packet_id", "field"]).where(
        (F.col("value") != "") & ~F.col("value").eqNullSafe(F.col("current"))
    )


def edited_items(lines: DataFrame) -> DataFrame:
    """`packet_id, list, pos, id, text` of the items of the three lists."""
    names = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])
    line = full_trim("line")
    raw = F.regexp_replace(line, rf"\A-[{WS}]+", "")
    text = F.regexp_replace(raw, rf"<!--[{WS}]*{K.MARKER}:id=[^>]+-->", "")
    text = F.regexp_replace(text, rf"\A\[[{WS}]*[xX ][{WS}]*\][{WS}]*", "")
    text = F.regexp_replace(
        text, rf"(?i)\A\[(?:open|answered|waived)\](?:[{WS}]*\(blocking\))?[{WS}]*", "")
    text = full_trim(F.regexp_replace(text, r"_\(optional\)_", ""))
    return lines.where(F.col("heading").isin(list(LISTS)) & line.startswith("-")).select(
        "packet_id", names[F.col("heading")].alias("list"), "pos",
        F.nullif(F.regexp_extract(raw, ITEM_ID, 1), F.lit("")).alias("id"), text.alias("text"),
    )


def merge_edits(ps: PacketSet, lines: DataFrame) -> DataFrame:
    """Every list item with its `action`: kept, changed, deleted, unknown (an id
    the packet does not have; ignored) or no_id (only flags a change)."""
    current = reduce(DataFrame.unionByName, [
        getattr(ps, n).select("packet_id", F.lit(n).alias("list"), "id", F.col("text").alias("was"))
        for n in LISTS.values()
    ])
    items = edited_items(lines)
    names = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])
    present = lines.where(F.col("is_head") & F.col("heading").isin(list(LISTS))).select(
        "packet_id", names[F.col("heading")].alias("list"), F.lit(True).alias("present")
    ).distinct()
    key = ["packet_id", "list", "id"]
    both = current.join(items.where("id IS NOT NULL"), key, "full_outer").join(
        present, ["packet_id", "list"], "left"
    )
    action = (
        F.when(F.col("was").isNull(), "unknown")
        .when(F.col("text").isNull(), F.when(F.col("present"), "deleted").otherwise("kept"))
        .when(F.col("text") == F.col("was"), "kept").otherwise("changed")
    )
    merged = both.select(*key, F.coalesce("text", "was").alias("text"), action.alias("action"), "pos")
    loose = items.where("id IS NULL").select(
        *key, "text", F.lit("no_id").alias("action"), "pos"
    )
    return merged.unionByName(loose)


def tamper_audit(current: DataFrame, edited: DataFrame) -> DataFrame:
    """Differences inside protected blocks: `packet_id, block, line, before, after`.

    A changed number of blocks is one row with block -1. Both sides are
    `packet_id, markdown`.
    """
    def blocks(df: DataFrame) -> DataFrame:
        return df.select(
            "packet_id", F.regexp_extract_all("markdown", F.lit(BLOCK), 1).alias("blocks"))

    pair = blocks(current).withColumnRenamed("blocks", "old").join(
        blocks(edited).withColumnRenamed("blocks", "new"), "packet_id")
    counts = pair.where(F.size("old") != F.size("new")).select(
        "packet_id", F.lit(-1).alias("block"), F.lit(0).alias("line"),
        F.size("old").cast("string").alias("before"), F.size("new").cast("string").alias("after"))
    # Blocks, then lines, are compared side by side in the row: nothing is shuffled again.
    same = pair.where(F.size("old") == F.size("new")).select(
        "packet_id", F.posexplode(F.arrays_zip("old", "new")).alias("block", "both"))
    lines = F.arrays_zip(
        F.split("both.old", "\r?\n", -1).alias("before"), F.split("both.new", "\r?\n", -1).alias("after"))
    diff = same.select("packet_id", "block", F.posexplode(lines).alias("i", "x")).where(
        ~F.col("x.before").eqNullSafe(F.col("x.after")))
    return counts.unionByName(diff.select(
        "packet_id", "block", (F.col("i") + 1).alias("line"),
        F.coalesce("x.before", F.lit("<missing>")).alias("before"),
        F.coalesce("x.after", F.lit("<missing>")).alias("after")))
