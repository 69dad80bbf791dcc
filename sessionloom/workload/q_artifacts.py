"""Queries over artifacts, packet documents and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import compile as C
from sessionloom.plans.packets import from_nested
from sessionloom.session import work_dir
from sessionloom.sources import artifacts as A
from sessionloom.sources import journals as J
from sessionloom.sources import packets as P
from sessionloom.sources.lines import write_lines
from sessionloom.workload.derived import check_sql, pick, table, text
from sessionloom.workload.inputs import packet_set
from sessionloom.workload.registry import query

KIND = pick(K.ARTIFACT_KINDS, "doc_id % 7")
FILE = f"'doc-' || {text('doc_id')} || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '.' || lang END"
AT = f"'2024-01-' || lpad({text('1 + doc_id % 28')}, 2, '0') || 'T00:00:00.000Z'"
OWNER = f"CASE WHEN doc_id % 9 <> 0 THEN 'conv-' || {text('doc_id % 120')} END"


def files(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "doc_id", f"{FILE} AS file", "text AS content", f"{AT} AS ingested_at",
        f"{KIND} AS kind", f"{OWNER} AS owner",
    )


def registered(spark, sf):
    return A.register(files(spark, sf), F.col("kind"), F.col("owner"))


REG = f"""
SELECT 'art-' || left(sha256(file || '|' || sha256(text)), 16) AS artifact_id, kind, file,
  CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest,
  CASE WHEN contains(file, '.') THEN split_part(file, '.', 2) ELSE '' END AS extension,
  owner AS packet_id, at AS ingested_at
FROM (SELECT *, {FILE} AS file, {AT} AS at, {KIND} AS kind, {OWNER} AS owner FROM documents) d""".replace(
    " AS at,", " AS stamp,").replace("at AS ingested_at", "stamp AS ingested_at")
RX = {"reg": REG}


@query("register_artifacts", check_sql("SELECT * FROM reg", RX))
def register_artifacts(spark, sf):
    return registered(spark, sf)


@query("dedup_artifacts", check_sql("""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ingested_at, artifact_id) AS rn
  FROM reg) r WHERE rn = 1 AND digest NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)""", RX))
def dedup_artifacts(spark, sf):
    known = table(spark, sf, "documents").where("doc_id % 5 = 0").select(
        F.sha2("text", 256).alias("digest")
    )
    return A.dedup(registered(spark, sf), known)


@query("unsupported_artifacts", check_sql("""
SELECT packet_id, 'COMPILE_UNSUPPORTED_ARTIFACT' AS code, 'warning' AS severity,
  'Unsupported artifact type for v1 fast mode: ' || kind || ' (' || file || ')' AS message
FROM reg WHERE kind <> 'transcript'""", RX))
def unsupported_artifacts(spark, sf):
    return A.unsupported(registered(spark, sf))


@query("collect_artifacts", check_sql("""
SELECT p.packet_id, count(*) FILTER (WHERE r.packet_id IS NOT NULL) AS n_own,
  count(*) FILTER (WHERE r.packet_id IS NULL) AS n_shared,
  arg_max(artifact_id, ingested_at || artifact_id) FILTER (WHERE kind = 'transcript') AS transcript_id
FROM packets p JOIN reg r ON r.packet_id IS NULL OR r.packet_id = p.packet_id GROUP BY p.packet_id""", RX))
def collect_artifacts(spark, sf):
    return C.last_transcripts(A.collected(registered(spark, sf)), table(spark, sf, "packets"))


@query("import_external", check_sql("""
SELECT 'ext-' || left(sha256('crawl|' || export_id), 16) AS artifact_id,
  CASE WHEN record_type = 'transcript' THEN 'transcript' ELSE 'note' END AS kind,
  'crawl:/' || export_id || '/' || regexp_replace(url, '^https?://', '') AS uri,
  'sha256:' || sha256(body) AS digest, CAST(strlen(body) AS BIGINT) AS bytes FROM exports"""))
def import_external(spark, sf):
    return A.import_external(
        table(spark, sf, "exports"), "crawl", F.col("export_id"), F.col("url"), F.col("body"),
        F.col("record_type") == "transcript",
    )


def documents_of_packets(spark, sf):
    """Packet JSON texts; some are cut off, lack a field or have an odd type."""
    p = table(spark, sf, "packets").withColumn(
        "n", F.substring("packet_id", 6, 20).cast("bigint")
    )
    lists = ["open_questions", "context_items", "constraints", "attempts", "acceptance_criteria",
             "warnings", "provenance_links", "source_artifacts"]
    repo = F.struct("attached", "root", "vcs", "branch", "base_branch", "commit", "base_commit",
                    "dirty")
    doc = F.to_json(F.struct(
        "schema_version", F.col("packet_id").alias("id"), "title", "status", "validation_level",
        "task_type", F.coalesce("objective", F.lit("none")).alias("objective"), "current_state",
        "next_action",
        F.when(F.col("n") % 12 != 5, F.col("confidence_score")).alias("confidence_score"),
        repo.alias("repo_context"),
        *[F.array().cast("array<string>").alias(x) for x in lists], "created_at", "updated_at",
        F.when(F.col("n") % 12 == 7, "x").alias("surprise"),
    ))
    return p.select(
        "packet_id",
        F.when(F.col("n") % 12 == 1, F.left(doc, F.char_length(doc) - 1))
        .when(F.col("n") % 12 == 2, F.concat(F.lit("["), doc, F.lit("]")))
        .when(F.col("n") % 12 == 3,
              F.regexp_replace(doc, '"confidence_score":([0-9.]+)', '"confidence_score":"$1"'))
        .otherwise(doc).alias("doc"),
    )


N12 = "CAST(substr(packet_id, 6) AS BIGINT) % 12"


@query("packet_document_findings", check_sql(f"""
SELECT packet_id, CASE WHEN {N12} IN (1, 2) THEN 'SL-engine' ELSE 'SL002' END AS code, 'critical' AS severity,
  CASE WHEN {N12} = 3 THEN '/confidence_score' ELSE '/' END AS path,
  CASE {N12} WHEN 3 THEN 'must be number' WHEN 5 THEN 'must have required property ''confidence_score'''
    WHEN 7 THEN 'must NOT have additional properties' ELSE 'packet is not an object' END AS message
FROM packets WHERE {N12} IN (1, 2, 3, 5, 7)
UNION ALL SELECT packet_id, 'SL004', 'error', '/confidence_score', 'confidence_score must be a number (got string).'
FROM packets WHERE {N12} = 3"""))
def packet_document_findings(spark, sf):
    return P.raw_violations(documents_of_packets(spark, sf), "packet_id")


@query("scan_packets", check_sql(f"""
SELECT packet_id, schema_version, title, status, attached, commit,
  CASE WHEN {N12} IN (3, 5) THEN NULL ELSE confidence_score END AS confidence_score
FROM packets WHERE {N12} NOT IN (1, 2)"""))
def scan_packets(spark, sf):
    good, _ = P.scan_packets(documents_of_packets(spark, sf))
    return from_nested(good).packets.select(
        "packet_id", "schema_version", "title", "status", "attached", "commit", "confidence_score"
    )


@query("scan_journal", check_sql("""
SELECT seq, id, packet_id, target_tool, status, created_at FROM dispatches WHERE seq % 7 <> 0 AND seq % 10 <> 9"""))
def scan_journal(spark, sf):
    rows = table(spark, sf, "dispatches")
    line = F.to_json(F.struct("id", "packet_id", "target_tool", "adapter", "status", "created_at"))
    lines = rows.select(
        "seq", F.when(F.col("seq") % 7 == 0, F.left(line, F.lit(20)))
        .when(F.col("seq") % 10 == 9, "  ").otherwise(F.concat(F.lit(" "), line)).alias("line"),
    )
    return J.parse_journal(lines, J.DISPATCH).select(
        "seq", "id", "packet_id", "target_tool", "status", "created_at"
    )


@query("packet_index", check_sql("""
SELECT packet_id AS id, title, status, validation_level, task_type,
  (SELECT count(*) FROM warnings w WHERE w.packet_id = p.packet_id) AS warning_count,
  (SELECT count(*) FROM warnings w WHERE w.packet_id = p.packet_id AND blocking) AS blocking_warning_count,
  confidence_score, created_at, updated_at FROM packets p"""))
def packet_index(spark, sf):
    from sessionloom.plans.packets import packet_index as index

    return index(packet_set(spark, sf))


@query("provenance_rows", check_sql(
    "SELECT packet_id, pos, id, field_name, artifact_id, ref, span_start, span_end FROM provenance_links"))
def provenance_rows(spark, sf):
    return packet_set(spark, sf).provenance_links.select(
        "packet_id", "pos", "id", "field_name", "artifact_id", "ref", "span_start", "span_end"
    )


@query("latest_session_file", check_sql("""
SELECT '2024/' || lpad(CAST(1 + conv_id % 12 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0')
  || '/rollout-' || conv_id || '.jsonl' AS file FROM (SELECT max(conv_id) AS conv_id FROM conversations) m"""))
def latest_session_file(spark, sf):
    """A session file of every conversation, the last one's written after the others;
    still newer files of other names or outside the date folders don't count."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id IS NOT NULL")
    day = "'2024/' || lpad(1 + conv_id % 12, 2, '0') || '/' || lpad(1 + conv_id % 28, 2, '0')"
    lines = turns.select("conv_id", F.expr(day).alias("day"), F.col("turn").alias("pos"), F.to_json(F.struct("role", "text")).alias("line"))
    last = turns.agg(F.max("conv_id")).first()[0]
    root = work_dir(spark, "sessions-by-day")
    for rows, path in (
        (lines.where(F.col("conv_id") < last), "day || '/rollout-' || conv_id || '.jsonl'"),
        (lines.where(F.col("conv_id") == last), "day || '/rollout-' || conv_id || '.jsonl'"),
        (lines.where("conv_id % 3 = 0"), "day || '/notes-' || conv_id || '.jsonl'"),
        (lines.where("conv_id % 3 = 1"), "'old/' || day || 'th/rollout-' || conv_id || '.jsonl'"),
    ):
        write_lines(rows.withColumn("artifact_id", F.expr(path)), root)
    found = A.latest_session_file(spark, root)
    return found.select(F.regexp_extract("path", r"[0-9]+/[0-9]+/[0-9]+/[^/]*\z", 0).alias("file"))
