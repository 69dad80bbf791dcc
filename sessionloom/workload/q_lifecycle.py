"""Queries over journals, versions, status and migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import lifecycle as Y
from sessionloom.plans.failover import POLICY
from sessionloom.plans.schema_rules import schema_violations
from sessionloom.plans.packets import packet_index
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.inputs import packet_set, packet_versions
from sessionloom.workload.q_compile import CX, NOW, compiled, priors
from sessionloom.workload.q_lint import VERSIONS
from sessionloom.workload.q_text import CLASSIFY, sql_trim
from sessionloom.workload.registry import query


def stored_outcomes(spark, sf):
    return Y.ingest_outcomes(table(spark, sf, "outcomes"), table(spark, sf, "packets"))[0]


TOOL = """coalesce(nullif(left(regexp_replace(source_tool, '[^a-zA-Z0-9_-]', '_', 'g'), 64), ''), 'unknown')"""
OUTCOMES = f"""
SELECT seq, id, packet_id, {TOOL} AS source_tool, {CLASSIFY.format(c='body')} AS classification,
  CASE WHEN left({sql_trim('body')}, 1) NOT IN ('{{', '[') THEN 'markdown' WHEN json_valid({sql_trim('body')}) THEN 'json' ELSE 'text' END AS format,
  'outcomes/' || replace(replace(created_at, ':', '-'), '.', '-') || '-' || {TOOL} || '.json' AS outcome_path, created_at
FROM outcomes WHERE packet_id IN (SELECT packet_id FROM packets)"""
OX = {"stored": OUTCOMES}


@query("ingest_outcomes", check_sql("SELECT * FROM stored", OX))
def ingest_outcomes(spark, sf):
    return stored_outcomes(spark, sf)


@query("rejected_outcomes", check_sql(
    "SELECT seq, id, packet_id FROM outcomes WHERE packet_id NOT IN (SELECT packet_id FROM packets)"))
def rejected_outcomes(spark, sf):
    return Y.ingest_outcomes(table(spark, sf, "outcomes"), table(spark, sf, "packets"))[1].select(
        "seq", "id", "packet_id"
    )


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY seq DESC) AS rn FROM {t}) l WHERE rn = 1"


@query("latest_events", check_sql(
    f"SELECT packet_id, 'dispatch' AS kind, seq, id FROM ({LATEST.format(t='dispatches')}) a "
    f"UNION ALL SELECT packet_id, 'outcome', seq, id FROM ({LATEST.format(t='stored')}) b", OX))
def latest_events(spark, sf):
    def part(df, kind):
        return Y.latest_by_packet(df.select("packet_id", "seq", "id")).select(
            "packet_id", F.lit(kind).alias("kind"), "seq", "id"
        )

    return part(table(spark, sf, "dispatches"), "dispatch").unionByName(
        part(stored_outcomes(spark, sf), "outcome")
    )


INDEX = """SELECT packet_id AS id, title, status, validation_level, task_type,
  (SELECT count(*) FROM warnings w WHERE w.packet_id = p.packet_id) AS warning_count,
  (SELECT count(*) FROM warnings w WHERE w.packet_id = p.packet_id AND blocking) AS blocking_warning_count,
  updated_at FROM packets p"""


@query("packet_status", check_sql(f"""
SELECT i.*, d.id AS receipt_id, d.target_tool, d.adapter, d.status AS dispatch_status, d.created_at AS dispatched_at,
  o.id AS outcome_id, o.classification, o.created_at AS outcome_at
FROM ({INDEX}) i LEFT JOIN ({LATEST.format(t='dispatches')}) d ON d.packet_id = i.id
LEFT JOIN ({LATEST.format(t='stored')}) o ON o.packet_id = i.id""", OX))
def packet_status(spark, sf):
    return Y.packet_status(
        packet_index(packet_set(spark, sf)), table(spark, sf, "dispatches"), stored_outcomes(spark, sf)
    )


VX = {**OX, "versions": VERSIONS}


@query("packet_history", check_sql(f"""
SELECT packet_id, 'version' AS kind, coalesce(nullif(updated_at, ''), '{Y.EPOCH}') AS at, seq,
  'v' || version AS ref, status AS label, validation_level AS target FROM versions
UNION ALL SELECT packet_id, 'dispatch', created_at, seq, id, status, target_tool FROM dispatches
UNION ALL SELECT packet_id, 'outcome', created_at, seq, id, classification, source_tool FROM stored""".replace(
    " AS at,", ' AS "at",'), VX))
def packet_history(spark, sf):
    return Y.packet_history(
        packet_versions(spark, sf), table(spark, sf, "dispatches"), stored_outcomes(spark, sf)
    )


@query("history_summary", check_sql("""
SELECT packet_id, count(*) FILTER (WHERE kind = 1) AS version_count, count(*) FILTER (WHERE kind = 2) AS dispatch_count,
  count(*) FILTER (WHERE kind = 3) AS outcome_count
FROM (SELECT packet_id, 1 AS kind FROM version_events UNION ALL SELECT packet_id, 2 FROM dispatches
  UNION ALL SELECT packet_id, 3 FROM stored) u GROUP BY packet_id""", OX))
def history_summary(spark, sf):
    return Y.history_summary(
        table(spark, sf, "version_events"), table(spark, sf, "dispatches"), stored_outcomes(spark, sf)
    )


@query("snapshot_versions", check_sql("""
SELECT p.packet_id, coalesce(l.version, 0) + 1 AS version, p.digest FROM (
  SELECT packet_id, md5(CAST(CAST(substr(packet_id, 6) AS BIGINT) % 50 AS VARCHAR)) AS digest FROM packets) p
LEFT JOIN (SELECT packet_id, max(version) AS version, arg_max(digest, version) AS digest FROM versions GROUP BY packet_id) l
  ON l.packet_id = p.packet_id WHERE l.digest IS NULL OR l.digest <> p.digest""", VX))
def snapshot_versions(spark, sf):
    current = table(spark, sf, "packets").selectExpr(
        "packet_id", "md5(CAST(CAST(substring(packet_id, 6) AS BIGINT) % 50 AS STRING)) AS digest"
    )
    return Y.snapshot_versions(packet_versions(spark, sf), current)


STORE = ["packet_id", "schema_version", "title", "status", "objective", "updated_at"]


@query("upsert_packets", check_sql(f"""
SELECT coalesce(n.packet_id, o.packet_id) AS packet_id,
  {', '.join(f"CASE WHEN n.packet_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in STORE[1:])},
  CASE WHEN n.packet_id IS NULL THEN 'keep' WHEN o.packet_id IS NULL THEN 'create' ELSE 'replace' END AS action
FROM (SELECT * FROM packets WHERE CAST(substr(packet_id, 6) AS BIGINT) % 3 <> 2) o
FULL JOIN (SELECT * FROM compiled WHERE length(title) BETWEEN 3 AND 200 AND length(objective) <= 4000
    AND length(current_state) <= 8000 AND confidence_score <= 1) n ON n.packet_id = o.packet_id""", CX))
def upsert_packets(spark, sf):
    new = compiled(spark, sf)
    policy = {n: F.expr(e) for n, e in POLICY.items()}
    lists = packet_set(spark, sf).restricted_to(new.limit(0))
    lists.packets = new.withColumns(policy)
    invalid = schema_violations(lists)
    return Y.upsert(priors(spark, sf).select(*STORE), new.select(*STORE), invalid)


@query("update_warnings", check_sql(f"""
SELECT w.packet_id, w.pos, w.code, w.message, CASE WHEN w.packet_id IN (SELECT packet_id FROM upd) THEN '{NOW}'
  ELSE p.updated_at END AS updated_at
FROM (SELECT packet_id, pos, code, message FROM warnings WHERE packet_id NOT IN (SELECT packet_id FROM upd)
  UNION ALL SELECT packet_id, pos, code, message FROM upd) w JOIN packets p ON p.packet_id = w.packet_id""",
    {"upd": "SELECT packet_id, CAST(0 AS BIGINT) AS pos, 'LINT_NEW' AS code, title AS message FROM packets WHERE status = 'draft'"}))
def update_warnings(spark, sf):
    ps = packet_set(spark, sf)
    updates = ps.packets.where("status = 'draft'").selectExpr(
        "packet_id", "CAST(0 AS BIGINT) AS pos", "'LINT_NEW' AS code", "'warning' AS severity",
        "title AS message", "false AS blocking", "'lint' AS source",
    )
    packets, warnings = Y.replace_warnings(ps.packets, ps.warnings, updates, NOW)
    return warnings.join(packets.select("packet_id", "updated_at"), "packet_id").select(
        "packet_id", "pos", "code", "message", "updated_at"
    )


EDGES = ", ".join(f"('{a}', '{b}')" for a, out in K.TRANSITIONS.items() for b in out)


@query("advance_status", check_sql(f"""
SELECT packet_id, status AS prior_status, CASE WHEN e.dst IS NOT NULL THEN wanted ELSE status END AS status
FROM (SELECT p.packet_id, p.status, CASE l.classification WHEN 'success' THEN 'completed'
    WHEN 'failure' THEN 'needs_clarification' WHEN 'incomplete' THEN 'ready_for_export' END AS wanted
  FROM packets p LEFT JOIN ({LATEST.format(t='stored')}) l ON l.packet_id = p.packet_id) x
LEFT JOIN (VALUES {EDGES}) e(src, dst) ON e.src = status AND e.dst = wanted""", OX))
def advance_status(spark, sf):
    return Y.advance_status(table(spark, sf, "packets"), stored_outcomes(spark, sf))


OLD_VERSION = "sessionloom.packet/v0"
STEPS = [
    *Y.MIGRATIONS,
    Y.Migration(OLD_VERSION, K.SCHEMA_VERSION, lambda df: df.withColumn(
        "confidence_score", F.least(F.col("confidence_score"), F.lit(1.0)))),
]


def _odd_versions(spark, sf):
    return table(spark, sf, "packets").withColumn(
        "schema_version", F.when(F.col("status") == "completed", "other/v9")
        .otherwise(F.col("schema_version"))
    )


@query("migrate_packets", check_sql(f"""
SELECT packet_id, CASE WHEN status = 'completed' THEN 'other/v9' ELSE '{K.SCHEMA_VERSION}' END AS schema_version,
  CASE WHEN schema_version = '{OLD_VERSION}' AND status <> 'completed' THEN least(confidence_score, 1.0::DOUBLE)
    ELSE confidence_score END AS confidence_score, status <> 'completed' AS migrated FROM packets"""))
def migrate_packets(spark, sf):
    done, lost = Y.migrate(_odd_versions(spark, sf), steps=STEPS)
    return done.withColumn("migrated", F.lit(True)).unionByName(
        lost.withColumn("migrated", F.lit(False))
    ).select("packet_id", "schema_version", "confidence_score", "migrated")


@query("session_ends", check_sql("""
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS opens
    FROM events) a) b GROUP BY user_id, session"""))
def session_ends(spark, sf):
    return Y.gap_sessions(table(spark, sf, "events"), "user_id", "ts", 7200).drop("session")
