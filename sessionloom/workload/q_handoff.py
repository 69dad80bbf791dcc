"""Queries over edited mirrors, conformance and the whole failover."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import conformance as O
from sessionloom.plans import lint as L
from sessionloom.plans import mirror as M
from sessionloom.plans import pipeline as P
from sessionloom.plans import render as R
from sessionloom.plans.failover import POLICY, compile_lines, failover
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.inputs import packet_set, packet_versions, session_lines
from sessionloom.workload.q_compile import COMPILED, NOW, PLACEHOLDER, PRIOR, nb, priors, title_sql
from sessionloom.workload.q_lint import CHANGED, FINDINGS, FRESH, FX, LAST_ILLEGAL, NUM, UNRESOLVED, VERSIONS, VIOLATIONS
from sessionloom.workload.q_lint import MISSING as MISSING_FILES
from sessionloom.workload.q_render import packets_of, rendered
from sessionloom.workload.q_sources import EV_EXPECTED, MD_EXPECTED, PLAIN_EXPECTED, PX, RO_EXPECTED, sql_trim
from sessionloom.workload.registry import query


def num():
    return F.expr("cast(substring(packet_id, 6) as bigint)")


def edited(mirrors):
    """Mirrors after some hand edits, chosen by packet number."""
    def when(cond, pattern, to):
        return F.when(cond, F.regexp_replace("markdown", pattern, to)).otherwise(F.col("markdown"))

    for cond, pattern, to in (
        (num() % 3 == 0, "Keep turn 0 intact", "Keep turn zero"),
        (num() % 4 == 1, r"- [^\n]*id=ac-1 -->\n", ""),
        (num() % 5 == 2, r"## Constraints\n\n", "## Constraints\n\n- new item without id\n"),
        (num() % 6 == 4, r"\*\*Confidence score:\*\* ", "**Confidence score:** 9"),
        (num() % 7 == 3, r"\z", f"\n{R.OPEN}\nextra\n{R.CLOSE}\n"),
        (num() % 8 == 5, r"\A# ", "# New "),
    ):
        mirrors = mirrors.withColumn("markdown", when(cond, pattern, to))
    return mirrors


NUMBER = "CAST(substr(packet_id, 6) AS BIGINT)"


@query("merge_edits", check_sql(f"""
SELECT packet_id, 'criteria' AS list, id, text, CASE WHEN {NUMBER} % 4 = 1 AND id = 'ac-1' THEN 'deleted' ELSE 'kept' END AS action FROM criteria
UNION ALL SELECT packet_id, 'constraints', id, CASE WHEN {NUMBER} % 3 = 0 THEN replace(text, 'Keep turn 0 intact', 'Keep turn zero') ELSE text END,
  CASE WHEN {NUMBER} % 3 = 0 AND id = 'c-0' THEN 'changed' ELSE 'kept' END FROM constraints
UNION ALL SELECT packet_id, 'constraints', NULL, 'new item without id', 'no_id' FROM packets WHERE {NUMBER} % 5 = 2
UNION ALL SELECT packet_id, 'questions', id, text, 'kept' FROM questions"""))
def merge_edits(spark, sf):
    ps = packets_of(spark, sf)
    lines = M.mirror_lines(edited(R.render_mirror(ps)))
    return M.merge_edits(ps, lines).drop("pos")


@query("field_edits", check_sql(f"""
SELECT packet_id, 'title' AS field, 'New ' || title AS value, title AS current FROM packets WHERE {NUMBER} % 8 = 5"""))
def field_edits(spark, sf):
    ps = packets_of(spark, sf)
    lines = M.mirror_lines(edited(R.render_mirror(ps)))
    return M.field_edits(ps.packets, lines)


@query("tamper_audit", check_sql(f"""
SELECT packet_id, -1 AS block, 0 AS line, '1' AS before, '2' AS after FROM packets WHERE {NUMBER} % 7 = 3
UNION ALL SELECT packet_id, 0, 5, '- **Confidence score:** ' || {NUM}, '- **Confidence score:** 9' || {NUM}
FROM packets WHERE {NUMBER} % 7 <> 3 AND {NUMBER} % 6 = 4""".replace(" AS before", ' AS "before"').replace(" AS after", ' AS "after"')))
def tamper_audit(spark, sf):
    mirrors = R.render_mirror(packets_of(spark, sf))
    return M.tamper_audit(mirrors, edited(mirrors))


EXPECTED = f"""
SELECT packet_id, 'status' AS path, 'draft' AS value FROM packets WHERE {NUMBER} % 2 = 0
UNION ALL SELECT packet_id, 'context_items[0].kind', 'file' FROM packets WHERE {NUMBER} % 3 = 0
UNION ALL SELECT packet_id, 'context_items[6].kind', 'test' FROM packets WHERE {NUMBER} % 4 = 0"""
ACTUAL = """
SELECT packet_id, 'status' AS path, status AS actual FROM packets
UNION ALL SELECT packet_id, 'context_items[' || pos || '].kind', kind FROM context_items"""
SHAPES = """SELECT e.packet_id, e.path, e.value AS expected, a.actual FROM expected e
LEFT JOIN actual a ON a.packet_id = e.packet_id AND a.path = e.path WHERE a.actual IS DISTINCT FROM e.value"""
WANTED = f"SELECT packet_id, 'SL004' AS code FROM packets WHERE {NUMBER} % 2 = 0 UNION ALL SELECT packet_id, 'SL010' FROM packets WHERE {NUMBER} % 5 = 0"
MISSING = "SELECT packet_id, code FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.packet_id = w.packet_id AND f.code = w.code)"
KX = {**FX, "expected": EXPECTED, "actual": ACTUAL, "shapes": SHAPES, "wanted": WANTED, "missing": MISSING}


def _shapes(spark, sf):
    p = table(spark, sf, "packets")
    expected = p.select("packet_id", F.inline(F.filter(F.array(
        F.when(num() % 2 == 0, F.struct(F.lit("status").alias("path"), F.lit("draft").alias("value"))),
        F.when(num() % 3 == 0, F.struct(F.lit("context_items[0].kind").alias("path"), F.lit("file").alias("value"))),
        F.when(num() % 4 == 0, F.struct(F.lit("context_items[6].kind").alias("path"), F.lit("test").alias("value"))),
    ), lambda x: x.isNotNull())))
    actual = O.leaves(packet_set(spark, sf), ["status", "task_type"], {"context_items": ["kind", "ref"]})
    return O.shape_mismatches(expected, actual)


def _missing(spark, sf):
    p = table(spark, sf, "packets")
    wanted = p.select("packet_id", F.explode(F.filter(F.array(
        F.when(num() % 2 == 0, "SL004"), F.when(num() % 5 == 0, "SL010")), lambda x: x.isNotNull())).alias("code"))
    return O.missing_codes(wanted, L.row_findings(packet_set(spark, sf)))


@query("shape_mismatches", check_sql("SELECT * FROM shapes", KX))
def shape_mismatches(spark, sf):
    return _shapes(spark, sf)


@query("missing_codes", check_sql("SELECT * FROM missing", KX))
def missing_codes(spark, sf):
    return _missing(spark, sf)


@query("conformance_summary", check_sql("""
SELECT count(*) FILTER (WHERE NOT bad) AS passed, count(*) FILTER (WHERE bad) AS failed, count(*) AS total FROM (
  SELECT packet_id IN (SELECT packet_id FROM shapes) OR packet_id IN (SELECT packet_id FROM missing) AS bad FROM packets) c""", KX))
def conformance_summary(spark, sf):
    return O.summary(table(spark, sf, "packets"), _shapes(spark, sf), _missing(spark, sf))


# Drafts from the session files: the expected messages of all formats, compiled.
ALL_MESSAGES = " UNION ALL ".join(
    f"SELECT artifact_id, role, text, span_start AS ord FROM ({q}) x"
    for q in (MD_EXPECTED, EV_EXPECTED, RO_EXPECTED, PLAIN_EXPECTED))
ENDS = f"""SELECT artifact_id AS packet_id, arg_min(text, ord) FILTER (WHERE role = 'user') AS first_user,
  arg_min(text, ord) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS first_prose,
  arg_max(text, ord) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS last_prose
FROM messages GROUP BY artifact_id"""


@query("compile_sessions", check_sql(f"""
SELECT packet_id, {title_sql("coalesce(first_user, first_prose, packet_id)")} AS title,
  coalesce({nb('first_user')}, '{K.DEFAULT_OBJECTIVE}') AS objective,
  coalesce({nb('last_prose')}, {nb('first_prose')}, '{K.DEFAULT_STATE}') AS current_state, '{K.DEFAULT_NEXT}' AS next_action
FROM ends2""", {**PX, "messages": ALL_MESSAGES, "ends2": ENDS}))
def compile_sessions(spark, sf):
    return compile_lines(session_lines(spark, sf), now=NOW).select(
        "packet_id", "title", "objective", "current_state", "next_action")


def _of_drafts(sql: str) -> str:
    """A checking query over the compiled drafts in place of the packet table."""
    return re.sub(r"\bpackets\b", "drafts", sql)


DRAFTS = """SELECT c.*, false AS has_policy, false AS approval_required, true AS dispatch_allowed, '' AS policy_reasons,
  CAST(NULL AS BIGINT) AS context_budget, false AS include_provenance, root AS repo FROM compiled2 c"""
GATE = f"""SELECT p.packet_id, count(*) FILTER (WHERE f.severity IN ('error', 'critical')) AS errors FROM drafts p
  LEFT JOIN (SELECT packet_id, severity FROM found2 UNION ALL SELECT packet_id, severity FROM violations2
    UNION ALL SELECT packet_id, severity FROM miss2 UNION ALL SELECT packet_id, severity FROM unres2
    UNION ALL SELECT packet_id, 'critical' FROM fresh2 WHERE stale UNION ALL SELECT packet_id, severity FROM moved2) f
  ON f.packet_id = p.packet_id GROUP BY p.packet_id"""
ROOTED = {"file_inventory": "rooted_files", "repo_refs": "rooted_refs", "repo_heads": "rooted_heads",
          "repo_diffs": "rooted_diffs", "changed_files": "rooted_changes"}


def _rooted(sql: str) -> str:
    """Over drafts, whose repository is named by its root folder."""
    for name, other in ROOTED.items():
        sql = re.sub(rf"\b{name}\b", other, sql)
    return re.sub(r"\btouched\b", "touched2", _of_drafts(sql))


def _state(spark, sf):
    def rooted(name):
        return table(spark, sf, name).withColumn("repo", F.concat(F.lit("/repos/"), "repo"))

    return L.RepoState(
        inventory=rooted("file_inventory"), refs=rooted("repo_refs"), heads=rooted("repo_heads"),
        diffs=rooted("repo_diffs"), changed=rooted("changed_files"), versions=packet_versions(spark, sf),
        approvals=table(spark, sf, "approvals"))


FAILOVER = {
    **PX, "messages": ALL_MESSAGES, "ends2": ENDS,
    "ends3": "SELECT CAST(substr(packet_id, 6) AS BIGINT) AS conv_id, first_user, first_prose, last_prose FROM ends2",
    "prior": PRIOR, "compiled2": COMPILED.replace("FROM ends e", "FROM ends3 e"), "drafts": DRAFTS,
    "found2": _of_drafts(FINDINGS), "violations2": _of_drafts(VIOLATIONS),
    **{v: f"SELECT * REPLACE ('/repos/' || repo AS repo) FROM {k}" for k, v in ROOTED.items()},
    "miss2": _rooted(MISSING_FILES), "unres2": _rooted(UNRESOLVED), "touched2": _rooted(CHANGED), "fresh2": _rooted(FRESH),
    "versions": VERSIONS, "moved2": _of_drafts(LAST_ILLEGAL), "gate": GATE,
    **{k: _of_drafts(v) for k, v in rendered("generic").items()},
}


@query("failover_handoffs", check_sql("""
SELECT g.packet_id, errors, errors = 0 AS passed, 'generic' AS target,
  CASE WHEN errors = 0 THEN CAST(0 AS BIGINT) END AS part_no, CASE WHEN errors = 0 THEN markdown END AS markdown,
  CASE WHEN errors = 0 THEN CAST(length(markdown) AS BIGINT) END AS chars
FROM gate g JOIN handed h ON h.packet_id = g.packet_id""", FAILOVER))
def failover_handoffs(spark, sf):
    return failover(session_lines(spark, sf), packet_set(spark, sf), "generic", priors(spark, sf),
                    table(spark, sf, "packets").where("attached"), NOW, _state(spark, sf))


KEPT = ["title", "objective", "current_state", "next_action"]
LINKED = f"""
SELECT packet_id, count(*) AS n_links, count(span_start) AS n_spans FROM (
  SELECT packet_id, (SELECT min(m.ord) FROM messages m WHERE m.artifact_id = v.packet_id AND {sql_trim('m.text')} = {sql_trim('v.value')}
      AND {sql_trim('v.value')} <> '') AS span_start
  FROM ({" UNION ALL ".join(f"SELECT packet_id, {f} AS value FROM drafts" for f in KEPT[1:])}) v WHERE value <> ''
  UNION ALL SELECT packet_id, NULL FROM context_items WHERE packet_id IN (SELECT packet_id FROM drafts)) x GROUP BY packet_id"""
STORED = f"""
SELECT coalesce(n.packet_id, o.packet_id) AS packet_id,
  {', '.join(f"CASE WHEN n.packet_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in KEPT)},
  CASE WHEN n.packet_id IS NULL THEN 'keep' WHEN o.packet_id IS NULL THEN 'create' ELSE 'replace' END AS action
FROM prior_packets o FULL JOIN (SELECT * FROM drafts WHERE packet_id NOT IN (SELECT packet_id FROM violations2)) n ON n.packet_id = o.packet_id"""


@query("compile_packets", check_sql("""
SELECT s.*, n_links, n_spans, CAST(1 AS BIGINT) AS n_artifacts FROM stored2 s JOIN linked l ON l.packet_id = s.packet_id""", {
    **{k: FAILOVER[k] for k in ("placed", "messages", "ends2", "ends3", "prior", "compiled2", "drafts", "violations2")},
    "prior_packets": f"SELECT * FROM packets WHERE {NUMBER} % 3 <> 2", "linked": LINKED, "stored2": STORED}))
def compile_packets(spark, sf):
    done = P.compile_packets(
        session_lines(spark, sf), packet_set(spark, sf), priors(spark, sf), KEPT, POLICY,
        table(spark, sf, "packets").where("attached"), NOW)
    links = done.links.groupBy("packet_id").agg(
        F.count("*").alias("n_links"), F.count("span_start").alias("n_spans"))
    artifacts = done.artifacts.groupBy("packet_id").agg(F.count("*").alias("n_artifacts"))
    return done.packets.join(links, "packet_id").join(artifacts, "packet_id")
