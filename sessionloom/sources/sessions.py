"""Session parsers: lines in, one row per message out.

Every parser takes a line table (see `lines.py`) and gives
`artifact_id, ord, role, text, ts, span_start, span_end`; `ord` orders the
messages of an artifact and spans are UTF-8 byte offsets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionloom import constants as K
from sessionloom.functions.text import WS, WS_CHARS, capped, full_trim, let
from sessionloom.operators.prefix import prefix_sums
from sessionloom.session import allow_repeated_keys, materialize
from sessionloom.sources.lines import chunk_bases

# Line patterns of the header format and type lists of the JSON formats (fixed values).
HEADER = rf"(?i)\A##[{WS}]+(user|assistant|system|tool)[{WS}]*\z"
TS_COMMENT = rf"(?i)<!--[{WS}]*ts:[{WS}]*([^{WS}][^>]*?)[{WS}]*-->"
FENCE = rf"\A[{WS}]*```"
EVENT_TYPES = ["user", "assistant"]
ROLLOUT_TYPES = ["session_meta", "turn_context", "event_msg", "response_item"]

MESSAGE = ["artifact_id", "ord", "role", "text", "ts", "span_start", "span_end"]


def detect_format(lines: DataFrame) -> DataFrame:
    """`artifact_id, fmt` from the first non-blank line of each artifact."""
    allow_repeated_keys(lines.sparkSession)
    first = (
        lines.select("artifact_id", "pos", full_trim("line").alias("line"))
        .where(F.col("line") != "")
        .groupBy("artifact_id")
        .agg(F.min_by("line", "pos").alias("line"))
    )
    kind = _string_at(F.try_parse_json("line"), "$.type")
    fmt = (
        F.when(~F.col("line").startswith("{") | kind.isNull(), "markdown")
        .when(kind.isin(ROLLOUT_TYPES), "rollout")
        .otherwise("events")
    )
    return first.select(
        "artifact_id",
        F.when((fmt == "markdown") & F.col("artifact_id").endswith(".jsonl"), "events")
        .otherwise(fmt)
        .alias("fmt"),
    )


def _string_at(v: Column, path: str) -> Column:
    """A JSON string at `path`; other JSON types give NULL, not their text."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def parse_markdown(lines: DataFrame) -> DataFrame:
    """Header format: `## Role` lines open messages, fences hide headers.

    Fence parity, message number and byte offset are running values over the
    artifact. They are first taken inside each chunk relative to its start, then
    the chunk totals are summed up, so a huge artifact is worked on chunk by chunk.
    """
    stripped = F.regexp_replace("line", r"\r\z", "")
    rows = lines.select(
        "artifact_id", "chunk", "pos",
        F.when(F.col("line").endswith("\r"), 2).otherwise(1).alias("last_end"),
        F.posexplode(F.split(stripped, "\r", -1)).alias("sub", "text"),
        F.size(F.split(stripped, "\r", -1)).alias("n_sub"),
    ).select(
        "artifact_id", "chunk", "pos", "sub", "text",
        F.octet_length("text").cast("bigint").alias("len"),
        F.when(F.col("sub") == F.col("n_sub") - 1, F.col("last_end")).otherwise(1).alias("end_len"),
        F.col("text").rlike(FENCE).cast("bigint").alias("fence"),
        F.lower(F.regexp_extract("text", HEADER, 1)).alias("head"),
    )
    inside = (
        Window.partitionBy("artifact_id", "chunk").orderBy("pos", "sub")
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rel = rows.select(
        "*",
        F.coalesce(F.sum("fence").over(before), F.lit(0)).alias("fences"),
        F.coalesce(F.sum(F.col("len") + F.col("end_len")).over(before), F.lit(0)).alias("bytes"),
    )
    is_head = (F.col("head") != "").cast("bigint")
    by_parity = [
        (is_head * (F.col("fences") % 2 == p).cast("bigint")).alias(f"head{p}") for p in (0, 1)
    ]
    rel = rel.select("*", *by_parity)
    over = Window.partitionBy("artifact_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )

    def sum_before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(over), F.lit(0))

    base = (
        rel.groupBy("artifact_id", "chunk")
        .agg(
            F.sum("fence").alias("t_fence"),
            F.sum(F.col("len") + F.col("end_len")).alias("t_bytes"),
            F.sum("head0").alias("t_head0"),
            F.sum("head1").alias("t_head1"),
        )
        .select(
            "*",
            sum_before(F.col("t_bytes")).alias("b_bytes"),
            (sum_before(F.col("t_fence")) % 2).alias("parity"),
        )
        .select(
            "*",
            sum_before(
                F.when(F.col("parity") == 0, F.col("t_head0")).otherwise(F.col("t_head1"))
            ).alias("b_msg"),
        )
        .select("artifact_id", "chunk", "b_bytes", "parity", "b_msg")
    )
    opens = F.when(F.col("parity") == 0, F.col("head0")).otherwise(F.col("head1"))
    placed = (
        rel.join(base, ["artifact_id", "chunk"])
        .select(
            "artifact_id", "pos", "sub", "text", "head", "chunk",
            (F.col("b_bytes") + F.col("bytes")).alias("start"),
            (F.col("b_bytes") + F.col("bytes") + F.col("len")).alias("end"),
            (opens == 1).alias("opens"),
            ((F.col("fence") == 0) & ((F.col("parity") + F.col("fences")) % 2 == 0)).alias("plain"),
            (F.col("b_msg") + F.sum(opens).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )).alias("ord"),
        )
        .where(F.col("ord") > 0)
        .withColumn("ts", F.when(~F.col("opens") & F.col("plain"),
                                 F.regexp_extract("text", TS_COMMENT, 1)))
        .withColumn("ts", F.when(F.col("ts") != "", F.col("ts")))
    )
    body = placed.groupBy("artifact_id", "ord").agg(
        F.max(F.when(F.col("opens"), F.col("head"))).alias("role"),
        F.array_sort(
            F.collect_list(
                F.when(~F.col("opens"), F.struct("pos", "sub", "text", "start", "end", "ts"))
            )
        ).alias("body"),
    )
    # Only the first time stamp comment of a message is taken out of its text.
    first_ts = F.get(F.filter("body", lambda x: x["ts"].isNotNull()), F.lit(0))
    stamped = body.withColumn("first", first_ts)

    def same(x: Column) -> Column:
        return (x["pos"] == F.col("first.pos")) & (x["sub"] == F.col("first.sub"))

    kept = F.filter(
        F.transform(
            "body",
            lambda x: F.struct(
                F.when(F.coalesce(same(x), F.lit(False)),
                       F.nullif(full_trim(F.regexp_replace(x["text"], TS_COMMENT, "")), F.lit("")))
                .otherwise(x["text"]).alias("text"),
                x["start"].alias("start"), x["end"].alias("end"),
            ),
        ),
        lambda x: x["text"].isNotNull(),
    )
    return (
        stamped.withColumn("kept", kept)
        .select(
            "artifact_id", "ord", "role",
            full_trim(F.array_join(F.transform("kept", lambda x: x["text"]), "\n")).alias("text"),
            F.col("first.ts").alias("ts"),
            F.get("kept", F.lit(0))["start"].alias("span_start"),
            F.get("kept", F.size("kept") - 1)["end"].alias("span_end"),
        )
        .where((F.col("text") != "") | F.col("ts").isNotNull())
        .select(*MESSAGE)
    )


def _json_lines(lines: DataFrame) -> DataFrame:
    """JSON object lines with their byte span and parsed value."""
    allow_repeated_keys(lines.sparkSession)
    sized = lines.withColumn("bytes", F.octet_length("line").cast("bigint") + 1)
    if "base" in lines.columns:
        w = Window.partitionBy("artifact_id", "chunk").orderBy("pos")
        inside = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))
        placed = sized.withColumn("span_start", F.col("base") + F.coalesce(inside, F.lit(0)))
    else:
        placed = prefix_sums(
            sized, ["artifact_id"], ["chunk"], ["pos"], {"span_start": "bytes"}
        )
    return (
        placed.withColumn("span_end", F.col("span_start") + F.col("bytes") - 1)
        .withColumn("line", full_trim("line"))
        .where(F.col("line").startswith("{"))
        .withColumn("v", F.try_parse_json("line"))
        .where(F.col("v").isNotNull())
    )


def _block_text(content: Column, depth: int) -> Column:
    """Readable text of a content value: a string, or a list of blocks."""
    if depth == 0:
        return F.when(F.schema_of_variant(content) == "STRING",
                      F.try_variant_get(content, "$", "string")).otherwise("")

    def part(b: Column) -> Column:
        kind = _string_at(b, "$.type")
        name = _string_at(b, "$.name")
        inner = _block_text(F.try_variant_get(b, "$.content", "variant"), depth - 1)
        return (
            F.when(kind == "text", _string_at(b, "$.text"))
            .when((kind == "tool_use") & name.isNotNull(),
                  F.concat(F.lit("[tool: "), name, F.lit("]")))
            .when(kind == "tool_result",
                  let(inner, lambda t: F.when(t != "", F.concat(F.lit("[tool_result] "), t))))
        )

    blocks = F.try_variant_get(content, "$", "array<variant>")
    joined = full_trim(F.array_join(F.transform(blocks, part), "\n"))
    return (
        F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
        .when(_is_array(content), joined)
        .otherwise("")
    )


def _cut(content: Column, depth: int) -> Column:
    """Whether `_block_text` with this depth would leave a nested list out."""
    if depth == 0:
        return F.coalesce(_is_array(content), F.lit(False))
    blocks = F.try_variant_get(content, "$", "array<variant>")
    return F.coalesce(
        _is_array(content) & F.exists(blocks, lambda b: F.coalesce(
            (_string_at(b, "$.type") == "tool_result")
            & _cut(F.try_variant_get(b, "$.content", "variant"), depth - 1), F.lit(False))),
        F.lit(False))


#: Levels of tool results that are read by expressions; deeper content goes to `nested_text`.
INLINE_DEPTH = 3


def nested_text(content: object) -> str:
    """`_block_text` of decoded JSON content at any depth, without recursion."""
    if not isinstance(content, list):
        return content if isinstance(content, str) else ""
    lists: list[tuple[Iterator, list[str]]] = [(iter(content), [])]
    while True:
        blocks, parts = lists[-1]
        for b in blocks:
            kind = b.get("type") if isinstance(b, dict) else None
            if kind == "text" and isinstance(b.get("text"), str):
                parts.append(b["text"])
            elif kind == "tool_use" and isinstance(b.get("name"), str):
                parts.append(f"[tool: {b['name']}]")
            elif kind == "tool_result" and isinstance(b.get("content"), list):
                lists.append((iter(b["content"]), []))
                break
            elif kind == "tool_result" and isinstance(b.get("content"), str) and b["content"]:
                parts.append(f"[tool_result] {b['content']}")
        else:
            lists.pop()
            text = "\n".join(parts).strip(WS_CHARS)
            if not lists:
                return text
            if text:
                lists[-1][1].append(f"[tool_result] {text}")


@F.pandas_udf(StringType())
def _deep_text(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else nested_text(json.loads(t)))


def parse_events(lines: DataFrame, depth: int | None = None) -> DataFrame:
    """Event format: one JSON event per line, `message.content` text or blocks,
    nested to any depth unless `depth` limits it.

    The plan does not depend on the data: three levels are read by expressions, and
    only the content of a line that has more goes through a function over its JSON.
    """
    kind = _string_at(F.col("v"), "$.type")
    role = F.lower(_string_at(F.col("v"), "$.message.role"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    events = _json_lines(lines).withColumn("kind", kind).where(F.col("kind").isin(EVENT_TYPES))
    text = _block_text(content, INLINE_DEPTH if depth is None else depth)
    if depth is None:
        # A line with fewer marks, plain or escaped, has no such depth.
        marks = F.size(F.split("line", "tool_result|\\\\u")) - 1
        deep = F.when((marks >= INLINE_DEPTH) & _cut(content, INLINE_DEPTH), F.to_json(content))
        events = events.withColumn("deep", _deep_text(deep))
        text = F.when(F.col("deep").isNotNull(), F.col("deep")).otherwise(text)
    return (
        events.select(
            "artifact_id", F.col("pos").alias("ord"),
            F.when(role.isin(K.ROLES), role).otherwise(F.col("kind")).alias("role"),
            text.alias("text"), _string_at(F.col("v"), "$.timestamp").alias("ts"),
            "span_start", "span_end",
        )
        .where(F.col("text") != "")
        .select(*MESSAGE)
    )


def parse_rollout(lines: DataFrame) -> DataFrame:
    """Rollout format: user and agent messages, tool calls and their output."""
    kind = _string_at(F.col("v"), "$.type")
    sub = _string_at(F.col("v"), "$.payload.type")
    said = F.coalesce(_string_at(F.col("v"), "$.payload.message"), F.lit(""))
    name = F.coalesce(_string_at(F.col("v"), "$.payload.name"), F.lit("tool"))
    out = F.coalesce(_string_at(F.col("v"), "$.payload.output"), F.lit(""))
    is_msg, is_item = F.col("kind") == "event_msg", F.col("kind") == "response_item"
    is_call = is_item & F.col("sub").isin("function_call", "custom_tool_call")
    is_out = is_item & F.col("sub").isin("function_call_output", "custom_tool_call_output")
    role = (
        F.when(is_msg & (F.col("sub") == "user_message"), "user")
        .when(is_msg & (F.col("sub") == "agent_message"), "assistant")
        .when(is_call | (is_item & (F.col("sub") == "web_search_call")), "assistant")
        .when(is_out, "tool")
    )
    text = (
        F.when(is_msg, said)
        .when(is_call, F.concat(F.lit("[tool: "), name, F.lit("]")))
        .when(is_out, F.when(out != "", F.concat(F.lit("[tool_result] "),
                                                 capped(out, K.TOOL_OUTPUT_CAP))))
        .otherwise("[tool: web_search]")
    )
    return (
        _json_lines(lines)
        .select("*", kind.alias("kind"), sub.alias("sub"))
        .select(
            "artifact_id", F.col("pos").alias("ord"), role.alias("role"), text.alias("text"),
            _string_at(F.col("v"), "$.timestamp").alias("ts"), "span_start", "span_end",
        )
        .where(F.col("role").isNotNull() & (F.col("text") != ""))
        .select(*MESSAGE)
    )


# Parsers by session format; add an entry to read a further format.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "markdown": parse_markdown,
    "events": parse_events,
    "rollout": parse_rollout,
}


def tag_lines(lines: DataFrame) -> DataFrame:
    """Lines with the format of their artifact and the byte base of their chunk.

    Both are attached by chunk, never by artifact alone, so the lines of one huge
    artifact stay spread out.
    """
    bases = chunk_bases(lines).join(detect_format(lines), "artifact_id", "left")
    return lines.join(
        bases.withColumn("fmt", F.coalesce("fmt", F.lit("markdown"))), ["artifact_id", "chunk"]
    )


def unrecognized(tagged: DataFrame, parsed: DataFrame) -> DataFrame:
    """Artifacts without any message, as one plain assistant text each.

    The lines of a chunk are joined first, then the chunks of an artifact; the
    outer white space of the whole text is removed.
    """
    seen = parsed.groupBy("artifact_id").agg(F.lit(1).alias("seen"))
    chunks = (
        tagged.groupBy("artifact_id", "chunk")
        .agg(F.lit(1).alias("n"))
        .join(seen, "artifact_id", "left_anti")
        .drop("n")
    )

    def joined(order: str, text: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(rows, lambda x: x[text]), "\n")

    return (
        tagged.join(chunks, ["artifact_id", "chunk"])
        .groupBy("artifact_id", "chunk", "base", "bytes")
        .agg(joined("pos", "line").alias("text"))
        .groupBy("artifact_id")
        .agg(joined("chunk", "text").alias("text"), F.sum("bytes").alias("bytes"))
        .select(
            "artifact_id", F.lit(0).cast("bigint").alias("ord"), F.lit("assistant").alias("role"),
            full_trim("text").alias("text"), F.lit(None).cast("string").alias("ts"),
            F.lit(0).cast("bigint").alias("span_start"), (F.col("bytes") - 1).alias("span_end"),
        )
    )


def parse_sessions(lines: DataFrame) -> DataFrame:
    """Detect, parse and fall back: all messages of all artifacts.

    Adds `fmt` and `unrecognized`. The tagged lines are written once, partitioned
    by format, so that each parser reads its own format only; the messages are
    written once because the fallback needs to know who has none.
    """
    tagged = materialize(tag_lines(lines), "lines", partition_by=["fmt"])
    parts = [
        parser(tagged.where(F.col("fmt") == name)).withColumn("fmt", F.lit(name))
        for name, parser in PARSERS.items()
    ]
    parsed = materialize(reduce(DataFrame.unionByName, parts), "messages")
    rest = unrecognized(tagged, parsed).withColumn("fmt", F.lit("plain"))
    return parsed.withColumn("unrecognized", F.lit(False)).unionByName(
        rest.withColumn("unrecognized", F.lit(True))
    )


def unrecognized_warnings(parsed: DataFrame) -> DataFrame:
    """One info row per artifact that was taken as plain text."""
    return parsed.where("unrecognized").select("artifact_id").distinct().select(
        "artifact_id", F.lit("COMPILE_TRANSCRIPT_UNRECOGNIZED").alias("code"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("Transcript at "), F.col("artifact_id"),
                 F.lit(" did not match a known format; treated as plain text.")).alias("message"),
    )
