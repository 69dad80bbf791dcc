"""Queries over text scans, scalars and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions import secrets as X
from sessionloom.functions import text as T
from sessionloom.functions.metadata import loggable, rejected_keys
from sessionloom.operators import scan
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.registry import query

WSQ = T.WS_PLAIN
BOUNDARY = rf"[{WSQ},;''\x{{22}}`<>(){{}}\[\]]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WSQ}]+|[{WSQ}]+$', '', 'g')"


# Independent token split: cut at every boundary character, count one for each cut.
TOKENS = """
SELECT id, txt, off, tok FROM (
  SELECT id, txt, tok, i, coalesce(sum(length(tok) + 1) OVER (PARTITION BY id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT id, txt, unnest(parts) AS tok, unnest(range(len(parts))) AS i
    FROM (SELECT id, txt, string_split_regex(txt, '""" + BOUNDARY + """') AS parts FROM src) p) q) r
WHERE tok <> ''"""


def secret_hits_sql(threshold: float) -> str:
    prefix = " OR ".join(f"starts_with(tok, '{p}')" for p in K.SECRET_PREFIXES)
    words = "|".join(K.SECRET_KEYWORDS)
    return f"""
SELECT id, 'prefix' AS kind, CAST(off AS BIGINT) AS "offset", CAST(length(tok) AS BIGINT) AS "length", tok AS "match"
FROM toks WHERE length(tok) >= {K.PREFIX_MIN_LENGTH} AND ({prefix})
UNION ALL
SELECT id, 'entropy', CAST(off AS BIGINT), CAST(length(tok) AS BIGINT), tok FROM (
  SELECT *, round(list_sum(list_transform(list_distinct(string_split(tok, '')), lambda c:
    -((length(tok) - length(replace(tok, c, ''))) / length(tok)::DOUBLE)
    * log2((length(tok) - length(replace(tok, c, ''))) / length(tok)::DOUBLE))), 9) AS h
  FROM toks WHERE length(tok) >= {K.ENTROPY_MIN_LENGTH}) e
WHERE h >= {threshold} AND regexp_matches(lower(substr(txt, CAST(greatest(off - 40, 0) AS BIGINT) + 1,
  CAST(off + length(tok) + 40 - greatest(off - 40, 0) AS BIGINT))), '{words}')
UNION ALL
SELECT id, 'env', CAST(off AS BIGINT), CAST(length(line) AS BIGINT), line FROM (
  SELECT id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT id, unnest(parts) AS line, unnest(range(len(parts))) AS i
    FROM (SELECT id, string_split(txt, chr(10)) AS parts FROM src) p) q) r
WHERE regexp_full_match(line, '[A-Z][A-Z0-9_]{{3,}}=[^{WSQ}]{{8,}}')
UNION ALL
SELECT id, 'pem', CAST(strpos(txt, m) - 1 AS BIGINT), CAST(length(m) AS BIGINT), m FROM (
  SELECT id, txt, unnest(regexp_extract_all(txt, '-----BEGIN [A-Z ]+ PRIVATE KEY-----')) AS m FROM src) p"""


SRC = {"src": "SELECT doc_id AS id, text AS txt FROM secret_texts", "toks": TOKENS}


@query("tokenize", check_sql(
    'SELECT id AS doc_id, CAST(off AS BIGINT) AS "offset", tok AS token FROM toks',
    {"src": "SELECT doc_id AS id, text AS txt FROM documents", "toks": TOKENS}))
def tokenize(spark, sf):
    return scan.tokenize(scan.spread(table(spark, sf, "documents")), "doc_id", "text").drop("pos")


@query("scan_secrets", check_sql(
    f'SELECT id AS doc_id, kind, "offset", "length", "match" FROM ({secret_hits_sql(4.0)}) s', SRC))
def scan_secrets(spark, sf):
    return scan.scan_secrets(scan.spread(table(spark, sf, "secret_texts")), ["doc_id"], "text")


@query("scan_secrets_low_threshold", check_sql(
    f'SELECT id AS doc_id, kind, "offset", "length", "match" FROM ({secret_hits_sql(3.5)}) s',
    {**SRC, "src": "SELECT doc_id AS id, text AS txt FROM documents"}))
def scan_secrets_low(spark, sf):
    return scan.scan_secrets(scan.spread(table(spark, sf, "documents")), ["doc_id"], "text", 3.5)


REDACTED = f"""
SELECT doc_id, string_agg(piece, '' ORDER BY "from") AS text FROM (
  SELECT t.doc_id, i."from", substr(t.text, i."from" + 1, i.until - i."from") || i.mark AS piece
  FROM secret_texts t JOIN (
    SELECT id, lag("end", 1, 0) OVER (PARTITION BY id ORDER BY start) AS "from", start AS until,
      '{K.REDACTED}' AS mark FROM islands
    UNION ALL SELECT id, max("end"), 1000000000, '' FROM islands GROUP BY id
    UNION ALL SELECT id, 0, 1000000000, '' FROM src WHERE id NOT IN (SELECT id FROM islands)) i
  ON i.id = t.doc_id) p GROUP BY doc_id"""
REDACTED_FROM = {
    **SRC, "hits": secret_hits_sql(4.0),
    "islands": """SELECT id, min("offset") AS start, max("offset" + "length") AS "end" FROM (
      SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY "offset", "length") AS island FROM (
        SELECT *, CASE WHEN "offset" >= coalesce(max("offset" + "length") OVER (PARTITION BY id
          ORDER BY "offset", "length" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          THEN 1 ELSE 0 END AS opens FROM hits) a) b GROUP BY id, island"""}


@query("redact_text", check_sql(REDACTED, REDACTED_FROM))
def redact_text(spark, sf):
    return scan.spread(table(spark, sf, "secret_texts")).select("doc_id", X.redact("text").alias("text"))


@query("redact_records", check_sql("""
SELECT doc_id, text AS plain, text AS listed, 'x' AS kept, text AS mapped, text AS deep, doc_id + 1 AS number, doc_id % 2 = 0 AS has_more
FROM clean""", {**REDACTED_FROM, "clean": REDACTED}))
def redact_records(spark, sf):
    rows = scan.spread(table(spark, sf, "secret_texts"))
    deep = F.struct(F.array(F.struct("text", (F.col("doc_id") + 1).alias("number"))).alias("inner"))
    record = F.struct(
        F.col("text").alias("plain"), F.array(F.lit("x"), F.col("text")).alias("listed"),
        F.create_map(F.lit("secret key"), F.array(F.col("text"))).alias("mapped"), F.array(deep, F.lit(None)).alias("deep"))
    more = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(None).cast("string").alias("text")))
    clean = X.redact_records(rows.select("doc_id", record.alias("record"), more.alias("more")))
    inner = F.col("record.deep")[0]["inner"][0]
    return clean.select(
        "doc_id", F.col("record.plain").alias("plain"), F.col("record.listed")[1].alias("listed"), F.col("record.listed")[0].alias("kept"),
        F.col("record.mapped")["secret key"][0].alias("mapped"), inner["text"].alias("deep"), inner["number"].alias("number"),
        (F.col("more").isNotNull() & F.col("record.deep")[1].isNull()).alias("has_more"))


def _words(words: list[str], open_words: list[str] = ()) -> str:
    p = rf"\b(?:{'|'.join(words)})\b"
    return p + (rf"|\b(?:{'|'.join(open_words)})" if open_words else "")


CLASSIFY = f"""CASE WHEN regexp_matches({{c}}, '{_words(K.FAILURE_HINTS)}', 'i') THEN 'failure'
  WHEN regexp_matches({{c}}, '{_words(K.INCOMPLETE_HINTS)}', 'i') THEN 'incomplete'
  WHEN regexp_matches({{c}}, '{_words(K.SUCCESS_HINTS, K.SUCCESS_OPEN_HINTS)}', 'i') THEN 'success'
  ELSE 'unknown' END"""


@query("classify_outcomes", check_sql(
    f"SELECT id, packet_id, {CLASSIFY.format(c='body')} AS classification FROM outcomes"))
def classify_outcomes(spark, sf):
    return table(spark, sf, "outcomes").select(
        "id", "packet_id", T.classify_outcome(F.col("body")).alias("classification")
    )


@query("payload_format", check_sql(f"""
SELECT id, CASE WHEN left({sql_trim('body')}, 1) NOT IN ('{{', '[') THEN 'markdown'
  WHEN json_valid({sql_trim('body')}) THEN 'json' ELSE 'text' END AS format FROM outcomes"""))
def payload_format(spark, sf):
    return table(spark, sf, "outcomes").select("id", T.payload_format(F.col("body")).alias("format"))


@query("clean_source", check_sql("""
SELECT id, coalesce(nullif(left(regexp_replace(source_tool, '[^a-zA-Z0-9_-]', '_', 'g'), 64), ''),
  'unknown') AS source_tool FROM outcomes"""))
def clean_source(spark, sf):
    return table(spark, sf, "outcomes").select(
        "id", T.clean_source(F.col("source_tool")).alias("source_tool")
    )


@query("derive_title", check_sql(f"""
SELECT doc_id, CASE WHEN length(t) >= 3 THEN t ELSE '{K.UNTITLED}' END AS title FROM (
  SELECT doc_id, CASE WHEN length(f) > 80 THEN left(f, 77) || '...' ELSE f END AS t FROM (
    SELECT doc_id, {sql_trim(f"regexp_replace(text, '[{WSQ}]+', ' ', 'g')")} AS f FROM documents) a) b"""))
def derive_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.derive_title(F.col("text")).alias("title"))


@query("token_estimates", check_sql(
    "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents"))
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.token_estimate(F.char_length("text")).alias("tokens")
    )


PLACEHOLDER = rf"regexp_full_match({sql_trim('text')}, '\[tool:[^\]]+\][{WSQ}]*') OR starts_with({sql_trim('text')}, '[tool_result]')"


@query("prose_turns", check_sql(
    f"SELECT conv_id, ord, text FROM turns WHERE role = 'assistant' AND NOT ({PLACEHOLDER})"))
def prose_turns(spark, sf):
    return table(spark, sf, "turns").where(
        (F.col("role") == "assistant") & ~T.is_tool_placeholder(F.col("text"))
    ).select("conv_id", "ord", "text")


@query("unsafe_refs", check_sql("""
SELECT packet_id, pos, ref, CASE WHEN starts_with(ref, '/') THEN 'absolute' ELSE 'traversal' END
  AS problem FROM context_items WHERE starts_with(ref, '/') OR starts_with(ref, '../')"""))
def unsafe_refs(spark, sf):
    return (
        table(spark, sf, "context_items")
        .select("packet_id", "pos", "ref", T.unsafe_ref(F.col("ref")).alias("problem"))
        .where("problem IS NOT NULL")
    )


LIMIT_RE = "|".join(K.LIMIT_MARKERS)


@query("limit_markers", check_sql(f"""
SELECT conv_id, min(turn) AS turn, count(*) AS hits FROM (
  SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn),
    {K.MARKER_SPAN - 1}), '') AS carry, text FROM chunk_texts) c
WHERE regexp_matches(carry || text, '{LIMIT_RE}', 'i') GROUP BY conv_id"""))
def limit_markers(spark, sf):
    chunks = table(spark, sf, "chunk_texts")
    seen = scan.with_carry(chunks, "conv_id", "turn", "text", K.MARKER_SPAN - 1)
    return (
        seen.where(T.has_limit_marker(F.col("window")))
        .groupBy("conv_id")
        .agg(F.min("turn").alias("turn"), F.count("*").alias("hits"))
    )


@query("log_allowlist", check_sql("""
SELECT event_id, command, regexp_replace(mode, ' sk-ant-[0-9a-f]+$', ' [REDACTED]') AS mode, exit_code, packet_id, CASE WHEN note IS NOT NULL THEN 'note' ELSE '' END
  AS rejected, 3 + (exit_code IS NOT NULL)::BIGINT AS kept FROM log_records"""))
def log_allowlist(spark, sf):
    raw = table(spark, sf, "log_records")
    names = ["command", "mode", "exit_code", "note", "packet_id"]
    pairs = F.map_filter(
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull()
    )
    m = raw.select("event_id", pairs.alias("kept_map")).withColumn("rejected", F.array_join(rejected_keys(F.col("kept_map")), ","))
    m = loggable(m, "kept_map")
    return m.select(
        "event_id", *[F.col("kept_map")[n].alias(n) for n in names if n != "note"], "rejected",
        F.size("kept_map").cast("bigint").alias("kept"),
    )
