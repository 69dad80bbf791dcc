"""Queries over sources: parsing, detection, registration, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions.text import WS_PLAIN
from sessionloom.session import work_dir
from sessionloom.sources import sessions as S
from sessionloom.sources.lines import DIGEST_FAN, digests, read_lines, write_lines
from sessionloom.workload.derived import CRLF, MD_FENCE, MD_TS, NL, check_sql, text
from sessionloom.workload.inputs import TURNS_PER_CHUNK, session_lines
from sessionloom.workload.registry import query

AID = f"'conv-' || {text('conv_id')}"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS_PLAIN}]+|[{WS_PLAIN}]+$', '', 'g')"


# Byte ranges of the blocks by arithmetic on the generated text.
PLACED = f"""
SELECT b.*, strlen(h.line) + 1 + h.crlf + coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  ord = max(ord) OVER (PARTITION BY conv_id) AS is_end
FROM (SELECT *, strlen(block) + 1 + crlf * (length(block) - length(replace(block, {NL}, '')) + 1) AS size
  FROM session_blocks) b JOIN (SELECT conv_id AS hid, line, crlf FROM session_heads) h ON h.hid = b.conv_id"""


def _messages(df):
    return df.select(
        "artifact_id", "role", "text", "ts", F.col("span_start").cast("bigint"),
        F.col("span_end").cast("bigint"),
    )


MD_EXPECTED = f"""
SELECT {AID} AS artifact_id, role,
  {sql_trim(f"text || {NL} || {MD_FENCE}")} AS text,
  CASE WHEN (conv_id + ord) % 2 = 0 THEN ts END AS ts,
  CAST(off + strlen('## ' || role) + 1 + crlf + (CASE WHEN (conv_id + ord) % 2 = 0
    THEN strlen({MD_TS}) + crlf ELSE 0 END) AS BIGINT) AS span_start,
  CAST(CASE WHEN is_end THEN off + size ELSE off + size - 1 - crlf END AS BIGINT) AS span_end
FROM placed WHERE fmt = 'markdown'"""
FIRST_LINE = f"strlen(CASE WHEN contains(block, {NL}) THEN split_part(block, {NL}, 1) ELSE block END)"
EV_EXPECTED = f"""
SELECT {AID} AS artifact_id, role, CASE WHEN ord % 8 = 0 THEN text
    ELSE {sql_trim('text')} END AS text, ts,
  CAST(off AS BIGINT) AS span_start, CAST(off + {FIRST_LINE} AS BIGINT) AS span_end
FROM placed WHERE fmt = 'events'"""
RO_EXPECTED = f"""
SELECT {AID} AS artifact_id, role,
  CASE WHEN ord % 4 = 2 AND (conv_id + ord) % 3 = 0
    THEN '[tool_result] ' || left(substr(text, 15) || ' ' || repeat('x', 600), 500) || '… [truncated]'
    ELSE text END AS text, ts,
  CAST(off AS BIGINT) AS span_start, CAST(off + strlen(block) AS BIGINT) AS span_end
FROM placed WHERE fmt = 'rollout' AND role <> 'system'"""
PLAIN_EXPECTED = f"""
SELECT {AID} AS artifact_id, 'assistant' AS role,
  {sql_trim(f"any_value(line) || {NL} || string_agg(block, {NL} ORDER BY ord) || {NL}")} AS text,
  CAST(NULL AS VARCHAR) AS ts, CAST(0 AS BIGINT) AS span_start,
  CAST(strlen(any_value(line) || {NL} || string_agg(block, {NL} ORDER BY ord) || {NL}) AS BIGINT) AS span_end
FROM session_blocks JOIN (SELECT conv_id AS hid, line FROM session_heads) h ON hid = conv_id
WHERE fmt = 'plain' GROUP BY conv_id"""
PX = {"placed": PLACED}


@query("parse_markdown_transcript", check_sql(MD_EXPECTED, PX))
def parse_markdown_transcript(spark, sf):
    return _messages(S.parse_markdown(session_lines(spark, sf, "markdown")))


@query("parse_event_jsonl", check_sql(EV_EXPECTED, PX))
def parse_event_jsonl(spark, sf):
    return _messages(S.parse_events(session_lines(spark, sf, "events")))


@query("parse_rollout_jsonl", check_sql(RO_EXPECTED, PX))
def parse_rollout_jsonl(spark, sf):
    return _messages(S.parse_rollout(session_lines(spark, sf, "rollout")))


@query("detect_session_format", check_sql(
    f"SELECT {AID} AS artifact_id, CASE WHEN fmt = 'plain' THEN 'markdown' ELSE fmt END AS fmt "
    "FROM session_heads"))
def detect_session_format(spark, sf):
    return S.detect_format(session_lines(spark, sf))


@query("unrecognized_sessions", check_sql(PLAIN_EXPECTED))
def unrecognized_sessions(spark, sf):
    parsed = S.parse_sessions(session_lines(spark, sf))
    return _messages(parsed.where("unrecognized"))


@query("parse_sessions", check_sql(" UNION ALL ".join(
    f"SELECT *, '{f}' AS fmt FROM ({q})" for f, q in (
        ("markdown", MD_EXPECTED), ("events", EV_EXPECTED), ("rollout", RO_EXPECTED),
        ("plain", PLAIN_EXPECTED))), PX))
def parse_sessions(spark, sf):
    parsed = S.parse_sessions(session_lines(spark, sf))
    return parsed.select(*_messages(parsed).columns, "fmt").withColumn(
        "span_start", F.col("span_start").cast("bigint")
    ).withColumn("span_end", F.col("span_end").cast("bigint"))


@query("unrecognized_warnings", check_sql(f"""
SELECT {AID} AS artifact_id, 'COMPILE_TRANSCRIPT_UNRECOGNIZED' AS code, 'info' AS severity,
  'Transcript at ' || {AID} || ' did not match a known format; treated as plain text.' AS message
FROM session_heads WHERE fmt = 'plain'"""))
def unrecognized_warnings(spark, sf):
    return S.unrecognized_warnings(S.parse_sessions(session_lines(spark, sf)))


@query("parse_session_files", check_sql(" UNION ALL ".join(
    f"SELECT *, '{f}' AS fmt FROM ({q})" for f, q in (
        ("markdown", MD_EXPECTED), ("events", EV_EXPECTED), ("rollout", RO_EXPECTED),
        ("plain", PLAIN_EXPECTED))), PX))
def parse_session_files(spark, sf):
    """All sessions written as files and read back by file split."""
    root = work_dir(spark, "session-files")
    write_lines(session_lines(spark, sf), root)
    parsed = S.parse_sessions(read_lines(spark, root))
    return parsed.select(
        F.regexp_extract("artifact_id", r"[^/]*\z", 0).alias("artifact_id"), "role", "text", "ts",
        F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"), "fmt")


@query("parse_nested_results", check_sql(f"""
SELECT {AID} AS artifact_id, turn AS ord,
  repeat('[tool_result] ', list_extract([0, 1, 3, 4, 5, 40], 1 + turn % 6)) || {sql_trim('text')} AS text
FROM conversations WHERE {sql_trim('text')} <> ''"""))
def parse_nested_results(spark, sf):
    """Every turn inside 0 to 40 levels of tool results."""
    level = F.element_at(F.array(*[F.lit(n) for n in (0, 1, 3, 4, 5, 40)]), (F.col("turn") % 6 + 1).cast("int"))
    block = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    content = F.concat(F.repeat(F.lit('[{"type":"tool_result","content":'), level), F.lit("["), block, F.lit("]"),
                       F.repeat(F.lit("}]"), level))
    lines = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("artifact_id"),
        F.floor(F.col("turn") / TURNS_PER_CHUNK).cast("bigint").alias("chunk"), F.col("turn").alias("pos"),
        F.concat(F.lit('{"type":"user","message":{"role":"user","content":'), content, F.lit("}}")).alias("line"))
    return S.parse_events(lines).select("artifact_id", "ord", "text")


END = "CASE WHEN crlf = 1 THEN chr(13) ELSE '' END"
FILE_LINES = f"""
SELECT conv_id, line || {END} AS line, -1 AS ord, 0 AS place FROM session_heads
UNION ALL SELECT conv_id, unnest(string_split(block, {NL})) || {END}, ord, generate_subscripts(string_split(block, {NL}), 1) FROM session_blocks
UNION ALL SELECT conv_id, '', max_turn * 4 + 4, 0 FROM session_heads"""


def _tree(below: str) -> str:
    return f"""SELECT conv_id, node // {DIGEST_FAN} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash
  FROM ({below}) GROUP BY conv_id, node // {DIGEST_FAN}"""


LEAVES = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord, place) - 1 AS node, sha256(line) AS hash FROM file_lines"
DIGESTS = f"""
SELECT {AID} AS artifact_id, n_lines, bytes, 'tree:' || sha256(list_aggregate(hashes, 'string_agg', '')) AS digest
FROM (SELECT conv_id, list(hash ORDER BY node) AS hashes FROM ({_tree(_tree(LEAVES))}) GROUP BY conv_id) t
JOIN (SELECT conv_id AS cid, count(*) AS n_lines, CAST(sum(strlen(line) + 1) - 1 AS BIGINT) AS bytes FROM file_lines GROUP BY conv_id) n
  ON n.cid = t.conv_id"""


@query("session_digests", check_sql(DIGESTS, {"file_lines": FILE_LINES}))
def session_digests(spark, sf):
    return digests(session_lines(spark, sf))
