"""Queries over compilation and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import compile as C
from sessionloom.workload.derived import check_sql, div, table, text
from sessionloom.workload.inputs import packet_set
from sessionloom.workload.q_text import PLACEHOLDER, WSQ, sql_trim
from sessionloom.workload.registry import query

NOW = "2024-03-01T00:00:00.000Z"


def turns(spark, sf):
    return table(spark, sf, "turns").withColumnRenamed("conv_id", "session_id")


def sessions(spark, sf):
    return table(spark, sf, "convs").select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("packet_id"),
    )


def priors(spark, sf):
    """Two thirds of the packets have been compiled before."""
    ps = table(spark, sf, "packets")
    return ps.where("CAST(substring(packet_id, 6) AS BIGINT) % 3 <> 2")


def compiled(spark, sf):
    repos = table(spark, sf, "packets").where("attached")
    return C.compile_fast(turns(spark, sf), sessions(spark, sf), priors(spark, sf), repos, NOW)


def nb(c):
    return f"nullif({sql_trim(c)}, '')"


FLAT = sql_trim(f"regexp_replace({{c}}, '[{WSQ}]+', ' ', 'g')".replace("{c}", "SEED"))


def title_sql(seed):
    flat = FLAT.replace("SEED", seed)
    short = f"(CASE WHEN length({flat}) > 80 THEN left({flat}, 77) || '...' ELSE {flat} END)"
    return f"(CASE WHEN length({short}) >= 3 THEN {short} ELSE '{K.UNTITLED}' END)"


ENDS = f"""
SELECT conv_id, arg_min(text, ord) FILTER (WHERE role = 'user') AS first_user,
  arg_min(text, ord) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS first_prose,
  arg_max(text, ord) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS last_prose
FROM turns GROUP BY conv_id"""
PRIOR = f"SELECT * FROM packets WHERE schema_version = '{K.SCHEMA_VERSION}' AND CAST(substr(packet_id, 6) AS BIGINT) % 3 <> 2"
COMPILED = f"""
SELECT 'conv-' || e.conv_id AS packet_id, e.conv_id AS session_id, '{K.SCHEMA_VERSION}' AS schema_version,
  coalesce({nb('p.title')}, {title_sql("coalesce(first_user, first_prose, 'conv-' || e.conv_id)")}) AS title,
  coalesce(p.status, 'draft') AS status, coalesce(p.validation_level, 'draft') AS validation_level,
  coalesce(p.task_type, 'generic') AS task_type,
  coalesce({nb('p.objective')}, {nb('first_user')}, '{K.DEFAULT_OBJECTIVE}') AS objective,
  coalesce({nb('p.current_state')}, {nb('last_prose')}, {nb('first_prose')}, '{K.DEFAULT_STATE}') AS current_state,
  coalesce({nb('p.next_action')}, '{K.DEFAULT_NEXT}') AS next_action,
  coalesce(p.confidence_score, 0.5::DOUBLE) AS confidence_score,
  r.packet_id IS NOT NULL AS attached, r.root, CASE WHEN r.packet_id IS NOT NULL THEN 'git' ELSE 'none' END AS vcs,
  r.branch, r.base_branch, r.commit, r.base_commit, coalesce(r.dirty, false) AS dirty,
  coalesce(p.created_at, '{NOW}') AS created_at, '{NOW}' AS updated_at
FROM ends e LEFT JOIN prior p ON p.packet_id = 'conv-' || e.conv_id
LEFT JOIN (SELECT * FROM packets WHERE attached) r ON r.packet_id = 'conv-' || e.conv_id"""
CX = {"ends": ENDS, "prior": PRIOR, "compiled": COMPILED}


@query("compile_fast", check_sql("SELECT * FROM compiled", CX))
def compile_fast(spark, sf):
    return compiled(spark, sf)


@query("prior_mismatch", check_sql(f"""
SELECT packet_id, 'COMPILE_PRIOR_SCHEMA_MISMATCH' AS code, 'warning' AS severity,
  'Prior packet has schema_version=''' || schema_version || ''', current is ''{K.SCHEMA_VERSION}''. Discarding prior narrative; rebuilding from scratch.' AS message
FROM packets WHERE schema_version <> '{K.SCHEMA_VERSION}' AND CAST(substr(packet_id, 6) AS BIGINT) % 3 <> 2"""))
def prior_mismatch(spark, sf):
    return C.prior_mismatch(priors(spark, sf))


@query("base_branch", check_sql("""
SELECT repo, CASE WHEN bool_or(kind = 'branch' AND ref = 'main') THEN 'main'
  WHEN bool_or(kind = 'branch' AND ref = 'master') THEN 'master' END AS base_branch
FROM repo_refs GROUP BY repo"""))
def base_branch(spark, sf):
    return C.base_branch(table(spark, sf, "repo_refs"))


# Spans as in a file that holds every turn on a line of its own.
SPANS = """SELECT *, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM turns"""
ART = "'transcript-' || left(md5('conv-' || conv_id), 16)"
LINKS = f"""
SELECT packet_id, CAST(pos AS BIGINT) AS pos, 'pl-' || left(sha256(field_name || '|' || artifact_id || '|' ||
    CASE WHEN span_start IS NULL THEN 'whole' ELSE span_start || '-' || span_end END), 16) AS id,
  field_name, artifact_id, 'transcript' AS source_type, ref, span_start, span_end
FROM (
  SELECT packet_id, pos, field_name, artifact_id, 'transcript:' || artifact_id AS ref,
    (SELECT arg_min(span_start, ord) FROM spans s WHERE s.conv_id = v.session_id AND {sql_trim('s.text')} = {sql_trim('v.value')}) AS span_start,
    (SELECT arg_min(span_start + strlen(s.text), ord) FROM spans s WHERE s.conv_id = v.session_id AND {sql_trim('s.text')} = {sql_trim('v.value')}) AS span_end
  FROM (SELECT packet_id, session_id, 'transcript-' || left(md5(packet_id), 16) AS artifact_id, 0 AS pos, 'objective' AS field_name, objective AS value FROM compiled
    UNION ALL SELECT packet_id, session_id, 'transcript-' || left(md5(packet_id), 16), 1, 'current_state', current_state FROM compiled
    UNION ALL SELECT packet_id, session_id, 'transcript-' || left(md5(packet_id), 16), 2, 'next_action', next_action FROM compiled) v
  UNION ALL SELECT packet_id, pos + 3, 'context_items[' || pos || ']', 'transcript-' || left(md5(packet_id), 16), ref,
    CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM context_items) x"""


def links(spark, sf):
    from sessionloom.operators.prefix import bucket, prefix_sums

    t = turns(spark, sf).select(
        "*", (F.octet_length("text").cast("bigint") + 1).alias("bytes"),
        bucket(F.col("ord")).alias("bucket"),
    )
    spans = prefix_sums(t, ["session_id"], ["bucket"], ["ord"], {"span_start": "bytes"}).withColumn(
        "span_end", F.col("span_start") + F.col("bytes") - 1
    )
    packets = compiled(spark, sf).withColumn(
        "artifact_id",
        F.concat(F.lit("transcript-"), F.left(F.md5(F.col("packet_id")), F.lit(16))),
    )
    return C.provenance_links(packets, table(spark, sf, "context_items"), spans)


LX = {**CX, "spans": SPANS, "links": LINKS}


@query("provenance_links", check_sql("SELECT * FROM links", LX))
def provenance_links(spark, sf):
    return links(spark, sf)


OLD = f"""SELECT packet_id, pos, CASE WHEN pos % 5 = 1 THEN 'pl-same' ELSE id END AS id, field_name,
  CASE WHEN pos % 2 = 0 THEN artifact_id ELSE 'transcript-old' END AS artifact_id, source_type, ref, span_start, span_end
FROM provenance_links"""


@query("merge_links", check_sql("""
SELECT packet_id, id, field_name, artifact_id, source_type, ref, span_start, span_end FROM (
  SELECT *, row_number() OVER (PARTITION BY packet_id, id ORDER BY rank, pos) AS rn FROM (
    SELECT o.*, 0 AS rank FROM old o WHERE NOT EXISTS (SELECT 1 FROM links l
      WHERE l.packet_id = o.packet_id AND l.artifact_id = o.artifact_id)
    UNION ALL SELECT *, 1 AS rank FROM links) u) r WHERE rn = 1""", {**LX, "old": OLD}))
def merge_links(spark, sf):
    old = table(spark, sf, "provenance_links").withColumns({
        "id": F.expr("CASE WHEN pos % 5 = 1 THEN 'pl-same' ELSE id END"),
        "artifact_id": F.expr("CASE WHEN pos % 2 = 0 THEN artifact_id ELSE 'transcript-old' END"),
    })
    return C.merge_links(old, links(spark, sf))


@query("merge_artifacts", check_sql("""
SELECT packet_id, id, type, source_tool, uri FROM source_artifacts
UNION ALL SELECT packet_id, 'transcript-' || left(md5(packet_id), 16), 'transcript', 'cli',
  'transcript:' || packet_id FROM packets WHERE packet_id NOT IN (SELECT packet_id FROM source_artifacts)"""))
def merge_artifacts(spark, sf):
    fresh = table(spark, sf, "packets").select(
        "packet_id",
        F.concat(F.lit("transcript-"), F.left(F.md5(F.col("packet_id")), F.lit(16))).alias("id"),
        F.lit("transcript").alias("type"), F.lit("cli").alias("source_tool"),
        F.concat(F.lit("transcript:"), F.col("packet_id")).alias("uri"),
    )
    have = table(spark, sf, "source_artifacts").select("packet_id", "id", "type", "source_tool", "uri")
    return C.merge_artifacts(have, fresh)


@query("span_union", check_sql("""
SELECT packet_id, min(span_start) FILTER (WHERE span_end >= span_start) AS span_start,
  max(span_end) FILTER (WHERE span_end >= span_start) AS span_end FROM provenance_links GROUP BY packet_id"""))
def span_union(spark, sf):
    return C.span_union(table(spark, sf, "provenance_links"), ["packet_id"])


@query("tail_excerpt", check_sql(r"""
SELECT conv_id AS session_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY ord) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord DESC) AS rn FROM turns) t
WHERE rn <= 12 GROUP BY conv_id"""))
def tail_excerpt(spark, sf):
    return C.tail_excerpt(turns(spark, sf))


@query("valid_ids", check_sql("""
SELECT packet_id, source_tool, regexp_full_match(packet_id, '[a-z0-9][a-z0-9._-]{1,127}') AS valid_packet,
  regexp_full_match(source_tool, '[a-z0-9][a-z0-9._-]{1,127}') AS valid_source
FROM outcomes"""))
def valid_ids(spark, sf):
    return table(spark, sf, "outcomes").select(
        "packet_id", "source_tool",
        F.col("packet_id").rlike(K.ID_PATTERN).alias("valid_packet"),
        F.col("source_tool").rlike(K.ID_PATTERN).alias("valid_source"),
    )
