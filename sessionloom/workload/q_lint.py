"""Queries over the rule set."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import lint as L
from sessionloom.plans.schema_rules import schema_violations as violations
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.inputs import packet_set, packet_versions
from sessionloom.workload.registry import query


def _list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CODE = f"task_type IN {_list(K.CODE_TASK_TYPES)}"
OUT = "status IN ('ready_for_export', 'dispatched')"
NUM = "CASE WHEN confidence_score = floor(confidence_score) THEN CAST(CAST(confidence_score AS BIGINT) AS VARCHAR) ELSE CAST(confidence_score AS VARCHAR) END"


def _sel(code, sev, path, msg, src, where):
    return (f"SELECT packet_id, 'SL{code}' AS code, '{sev}' AS severity, {path} AS path, "
            f"{msg} AS message FROM {src} WHERE {where}")


def _narr(f):
    return _sel("003", "error", f"'/{f}'", f"'Required narrative field ''{f}'' is missing or empty.'",
                "packets", f"coalesce(trim({f}), '') = ''")


CHILD = "(SELECT c.*, p.status AS p_status, p.validation_level, p.task_type FROM {t} c JOIN packets p USING (packet_id)) x"
FINDINGS = " UNION ALL ".join([
    _sel("001", "critical", "'/schema_version'",
         f"'schema_version must equal ''{K.SCHEMA_VERSION}'' (got ''' || schema_version || ''').'",
         "packets", f"schema_version <> '{K.SCHEMA_VERSION}'"),
    _narr("objective"), _narr("current_state"), _narr("next_action"),
    _sel("004", "error", "'/confidence_score'",
         f"'confidence_score must be between 0 and 1 (got ' || {NUM} || ').'", "packets",
         "confidence_score > 1 OR confidence_score < 0"),
    _sel("010", "error", "'/repo_context/attached'",
         "'task_type=''' || task_type || ''' requires repo_context.attached=true (got false).'",
         "packets", f"{CODE} AND NOT attached"),
    _sel("011", "error", "'/context_items'",
         "'task_type=''' || task_type || ''' requires at least one context_item with kind in {file,test,diff,log,issue}.'",
         "packets", f"{CODE} AND packet_id NOT IN (SELECT packet_id FROM context_items WHERE kind IN {_list(K.QUALIFYING_KINDS)})"),
    _sel("020", "error", "'/acceptance_criteria'",
         "'task_type=''' || task_type || ''' requires at least one ' || CASE WHEN packet_id IN (SELECT packet_id FROM criteria) "
         "THEN 'acceptance_criteria entry with required=true.' ELSE 'required acceptance_criteria entry (none present).' END",
         "packets", f"{CODE} AND packet_id NOT IN (SELECT packet_id FROM criteria WHERE required)"),
    _sel("041", "error", "'/validation_level'",
         """'Status "' || status || '" requires validation_level "ready", got "' || validation_level || '".'""",
         "packets", f"{OUT} AND validation_level <> 'ready'"),
    _sel("042", "error", "'/policy/approval_required'",
         "'Packet has policy.approval_required=true but no approval has been recorded; dispatch is not permitted.'",
         "packets", "has_policy AND approval_required AND status = 'dispatched' AND packet_id NOT IN (SELECT packet_id FROM approvals)"),
    _sel("043", "error", "'/policy/dispatch_allowed'",
         """'policy.dispatch_allowed is false but status is "dispatched"; dispatch is not permitted.' || CASE WHEN policy_reasons <> '' THEN ' Policy reasons: ' || policy_reasons || '.' ELSE '' END""",
         "packets", "has_policy AND NOT dispatch_allowed AND status = 'dispatched'"),
    _sel("021", "error", "'/open_questions/' || pos",
         "'open_question ''' || id || ''' is blocking and still open; packet cannot be ready.'",
         CHILD.format(t="questions"),
         f"blocking AND status = 'open' AND (validation_level = 'ready' OR p_status IN {_list(K.READY_STATUSES)})"),
    _sel("030", "error", "'/constraints/' || pos || '/provenance_refs'",
         "'constraint ''' || id || ''' has no provenance_refs.'", "constraints", "n_refs = 0"),
    _sel("031", "warning", "'/attempts/' || pos || '/artifact_refs'",
         "'failed attempt ''' || id || ''' has no artifact_refs evidencing the failure.'", "attempts",
         "n_refs = 0 AND result = 'failed'"),
    _sel("032", "warning", "'/acceptance_criteria/' || pos || '/provenance_refs'",
         "'acceptance_criterion ''' || id || ''' (source=''' || source || ''') has no provenance_refs.'",
         "criteria", "n_refs = 0 AND source IN ('user', 'ticket')"),
    _sel("033", "warning", "'/context_items/' || pos || '/provenance_refs'",
         "'high-priority context_item ''' || ref || ''' (priority=' || priority || ') has no provenance_refs.'",
         "context_items", "n_refs = 0 AND priority >= 4"),
    """SELECT packet_id, 'SL050' AS code, 'error' AS severity, '/warnings' AS path,
      'Status "' || any_value(p_status) || '" is gated by ' || count(*) || ' blocking warning(s): ' ||
      string_agg(code, ', ' ORDER BY pos) || '.' AS message FROM """ + CHILD.format(t="warnings")
    + " WHERE blocking AND p_status IN ('ready_for_export', 'dispatched') GROUP BY packet_id",
    _sel("060", "critical", "'/objective'", "'Apparent secret (prefix) at offset 4.'", "packets",
         "contains(objective, 'ghp' || '_')"),
    _sel("060", "critical", "'/constraints/' || pos || '/text'",
         "'Apparent secret (prefix) at offset ' || (strpos(text, 'ghp' || '_') - 1) || '.'", "constraints",
         "contains(text, 'ghp' || '_')"),
])
FX = {"found": FINDINGS}
ERR = "severity IN ('error', 'critical')"


@query("lint_findings", check_sql(f"SELECT *, {ERR} AS is_error FROM found", FX))
def lint_findings(spark, sf):
    return L.row_findings(packet_set(spark, sf), table(spark, sf, "approvals")).withColumn("is_error", L.is_error())


@query("lint_findings_strict", check_sql("SELECT *, true AS is_error FROM found", FX))
def lint_findings_strict(spark, sf):
    return L.row_findings(packet_set(spark, sf), table(spark, sf, "approvals")).withColumn("is_error", L.is_error(strict=True))


@query("findings_by_rule", check_sql(
    "SELECT code, severity, count(*) AS findings FROM found GROUP BY code, severity", FX))
def findings_by_rule(spark, sf):
    return L.findings_by_rule(L.row_findings(packet_set(spark, sf), table(spark, sf, "approvals")))


REPORT = f"""SELECT p.packet_id, CASE WHEN count(*) FILTER (WHERE {ERR}) > 0 THEN 'failed' ELSE 'passed' END AS status,
  count(*) FILTER (WHERE {ERR}) AS blocking_count,
  count(*) FILTER (WHERE NOT ({ERR})) AS warning_count
FROM packets p LEFT JOIN found f ON f.packet_id = p.packet_id GROUP BY p.packet_id"""


BAD_ID = "NOT regexp_full_match({c}, '[a-z0-9][a-z0-9._-]{{1,127}}')"


def _v(path, msg, src, where):
    return _sel("002", "critical", path, f"'{msg}'", src, where)


VIOLATIONS = " UNION ALL ".join([
    _v("'/schema_version'", "must be equal to constant", "packets", f"schema_version <> '{K.SCHEMA_VERSION}'"),
    _v("'/title'", "must NOT have fewer than 3 characters", "packets", "length(title) < 3"),
    _v("'/title'", "must NOT have more than 200 characters", "packets", "length(title) > 200"),
    _v("'/objective'", "must not be null", "packets", "objective IS NULL"),
    _v("'/objective'", "must NOT have fewer than 1 characters", "packets", "length(objective) < 1"),
    _v("'/objective'", "must NOT have more than 4000 characters", "packets", "length(objective) > 4000"),
    _v("'/next_action'", "must NOT have fewer than 1 characters", "packets", "length(next_action) < 1"),
    _v("'/confidence_score'", "must be <= 1", "packets", "confidence_score > 1"),
    _v("'/confidence_score'", "must be >= 0", "packets", "confidence_score < 0"),
    _v("'/constraints/' || pos || '/provenance_refs'", "must NOT have fewer than 1 items", "constraints", "n_refs < 1"),
    _v("'/context_items/' || pos || '/priority'", "must be <= 5", "context_items", "priority > 5"),
    _v("'/context_items/' || pos || '/ref'", "must NOT have more than 4096 characters", "context_items", "length(ref) > 4096"),
    _v("'/provenance_links/' || pos || '/span_end'", "must be >= 0", "provenance_links", "span_end < 0"),
    _v("'/provenance_links/' || pos || '/span_start'", "must be >= 0", "provenance_links", "span_start < 0"),
    _v("'/open_questions/' || pos || '/id'", f'must match pattern "{K.ID_PATTERN}"'.replace(r"\A", "^").replace(r"\z", "$"),
       "questions", BAD_ID.format(c="id")),
    *[_v(f"'/{path}/' || pos || '/{c}'", f"must NOT have more than {n} characters", src, f"length({c}) > {n}") for path, src, c, n in (
        ("open_questions", "questions", "text", 2000), ("constraints", "constraints", "text", 4000), ("attempts", "attempts", "summary", 4000),
        ("acceptance_criteria", "criteria", "text", 4000), ("warnings", "warnings", "message", 4000), ("context_items", "context_items", "reason", 2000))],
])


@query("schema_violations", check_sql(VIOLATIONS))
def schema_violations(spark, sf):
    return violations(packet_set(spark, sf))


MISSING = """
SELECT packet_id, 'SL012' AS code, 'error' AS severity, '/context_items/' || pos || '/ref' AS path,
  CASE WHEN starts_with(ref, '/') THEN 'context_item.ref must be a repo-relative path; absolute paths are not allowed'
    WHEN starts_with(ref, '../') THEN 'context_item.ref must not traverse outside the repo'
    ELSE 'context_item[' || pos || '] references missing ' || kind || ': ''' || ref || '''.' END AS message
FROM context_items i JOIN packets p USING (packet_id)
WHERE attached AND kind IN ('file', 'directory') AND repo IN (SELECT repo FROM file_inventory)
  AND NOT EXISTS (SELECT 1 FROM file_inventory f WHERE f.repo = p.repo AND f.path = i.ref)"""


@query("lint_missing_files", check_sql(MISSING))
def lint_missing_files(spark, sf):
    return L.missing_files(packet_set(spark, sf), table(spark, sf, "file_inventory"))


UNRESOLVED = """
SELECT packet_id, 'SL013' AS code, 'error' AS severity, '/repo_context/' || field AS path,
  'repo_context.' || field || '=''' || v || ''' does not resolve in the local repo.' AS message
FROM (SELECT packet_id, repo, 'branch' AS field, branch AS v FROM packets
  UNION ALL SELECT packet_id, repo, 'commit', commit FROM packets
  UNION ALL SELECT packet_id, repo, 'base_commit', base_commit FROM packets) u
WHERE v IS NOT NULL AND repo IN (SELECT repo FROM repo_refs) AND NOT EXISTS (
  SELECT 1 FROM repo_refs r WHERE r.repo = u.repo AND (r.ref = v
    OR (r.kind = 'commit' AND length(v) >= 7 AND starts_with(r.ref, v))))"""


@query("lint_unresolved_refs", check_sql(UNRESOLVED))
def lint_unresolved_refs(spark, sf):
    return L.unresolved_refs(packet_set(spark, sf), table(spark, sf, "repo_refs"))


CHANGED = """
SELECT i.packet_id, i.pos, i.ref AS path FROM context_items i JOIN packets p USING (packet_id)
JOIN repo_heads h ON h.repo = p.repo
WHERE p.attached AND p.commit <> h.head AND i.kind IN ('file', 'test', 'diff', 'log') AND EXISTS (
  SELECT 1 FROM changed_files c WHERE c.repo = p.repo AND c.from_commit = p.commit
    AND c.to_commit = h.head AND c.path = i.ref)"""
FRESH = """
SELECT packet_id, n > 0 AS stale, CASE WHEN NOT attached OR head IS NULL THEN 'repo not attached'
  WHEN commit IS NULL THEN 'packet has no recorded commit' WHEN commit = head THEN NULL
  WHEN NOT diffed THEN 'unable to diff packet commit against HEAD'
  WHEN NOT has_files THEN 'HEAD moved but no files changed'
  WHEN n = 0 THEN 'HEAD moved but referenced files unchanged'
  ELSE n || ' referenced file' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' changed since packet compiled'
  END AS reason, n AS n_changed
FROM (SELECT p.packet_id, p.attached, p.commit, h.head,
  EXISTS (SELECT 1 FROM repo_diffs d WHERE d.repo = p.repo AND d.from_commit = p.commit AND d.to_commit = h.head) AS diffed,
  EXISTS (SELECT 1 FROM changed_files c WHERE c.repo = p.repo AND c.from_commit = p.commit AND c.to_commit = h.head) AS has_files,
  (SELECT count(*) FROM touched t WHERE t.packet_id = p.packet_id) AS n
  FROM packets p LEFT JOIN repo_heads h ON h.repo = p.repo) x"""


def _fresh(spark, sf):
    return L.assess_freshness(
        packet_set(spark, sf), table(spark, sf, "repo_heads"), table(spark, sf, "repo_diffs"),
        table(spark, sf, "changed_files"),
    )


@query("changed_references", check_sql(CHANGED))
def changed_references(spark, sf):
    return L.changed_references(
        packet_set(spark, sf), table(spark, sf, "repo_heads"), table(spark, sf, "changed_files")
    )


@query("assess_freshness", check_sql(FRESH, {"touched": CHANGED}))
def assess_freshness(spark, sf):
    return _fresh(spark, sf)


@query("lint_stale_packets", check_sql(
    "SELECT packet_id, 'SL014' AS code, 'critical' AS severity, '/repo_context' AS path, "
    "'Packet is stale against current HEAD (' || reason || ').' AS message FROM fresh WHERE stale",
    {"touched": CHANGED, "fresh": FRESH}))
def lint_stale_packets(spark, sf):
    return L.stale_findings(_fresh(spark, sf))


VERSIONS = ("SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY seq) AS version "
            "FROM version_events")
EDGES = ", ".join(f"('{k}', '{', '.join(v) or '(terminal)'}')" for k, v in K.TRANSITIONS.items())
ILLEGAL = f"""
SELECT packet_id, version, 'SL040' AS code, CASE WHEN e.src IS NULL THEN 'warning' ELSE 'error' END AS severity,
  '/status' AS path, CASE WHEN e.src IS NULL
    THEN 'Unknown prior status "' || prior || '"; cannot evaluate transition.'
    ELSE 'Illegal status transition: "' || prior || '" -> "' || status || '". Allowed from "' || prior || '": ' || e.dst || '.'
    END AS message
FROM (SELECT *, lag(status) OVER (PARTITION BY packet_id ORDER BY version) AS prior FROM versions) v
LEFT JOIN (SELECT * FROM (VALUES {EDGES}) t(src, dst)) e ON e.src = prior
WHERE prior IS NOT NULL AND status <> prior
  AND (e.src IS NULL OR NOT list_contains(string_split(e.dst, ', '), status))"""


@query("lint_illegal_transitions", check_sql(ILLEGAL, {"versions": VERSIONS}))
def lint_illegal_transitions(spark, sf):
    return L.illegal_transitions(packet_versions(spark, sf))


LAST_ILLEGAL = f"""SELECT packet_id, code, severity FROM ({ILLEGAL}) i
WHERE version = (SELECT max(version) FROM versions v WHERE v.packet_id = i.packet_id)
  AND packet_id IN (SELECT packet_id FROM packets)"""
ALL_FOUND = {
    "found0": FINDINGS, "viol": VIOLATIONS, "miss": MISSING, "unres": UNRESOLVED,
    "touched": CHANGED, "fresh": FRESH, "versions": VERSIONS, "moved": LAST_ILLEGAL,
    "found": """SELECT packet_id, code, severity FROM found0 UNION ALL SELECT packet_id, code, severity FROM viol
    UNION ALL SELECT packet_id, code, severity FROM miss UNION ALL SELECT packet_id, code, severity FROM unres
    UNION ALL SELECT packet_id, 'SL014', 'critical' FROM fresh WHERE stale UNION ALL SELECT * FROM moved""",
}


def repo_state(spark, sf) -> L.RepoState:
    return L.RepoState(
        inventory=table(spark, sf, "file_inventory"), refs=table(spark, sf, "repo_refs"),
        heads=table(spark, sf, "repo_heads"), diffs=table(spark, sf, "repo_diffs"),
        changed=table(spark, sf, "changed_files"), versions=packet_versions(spark, sf),
        approvals=table(spark, sf, "approvals"))


def all_findings(spark, sf):
    ps = packet_set(spark, sf)
    return L.every_finding(ps, repo_state(spark, sf), violations(ps))


def _in(numbers):
    return _list([f"SL{n}" for n in numbers])


@query("certify", check_sql(f"""
SELECT p.packet_id, CASE WHEN count(*) FILTER (WHERE code IN {_in(L.VALID_RULES)}) > 0 THEN 'draft'
  WHEN count(*) FILTER (WHERE code IN {_in(L.VERIFIED_RULES)}) > 0 THEN 'valid'
  WHEN count(code) > 0 THEN 'verified' ELSE 'ready' END AS level
FROM packets p LEFT JOIN found f ON f.packet_id = p.packet_id GROUP BY p.packet_id""", ALL_FOUND))
def certify(spark, sf):
    return L.certify(packet_set(spark, sf).packets, all_findings(spark, sf))


@query("lint_gate", check_sql(f"""
SELECT p.packet_id, count(*) FILTER (WHERE {ERR} AND code <> 'SL002') AS errors,
  count(*) FILTER (WHERE code = 'SL002') AS schema_errors, count(*) FILTER (WHERE {ERR}) = 0 AS passed
FROM packets p LEFT JOIN found f ON f.packet_id = p.packet_id GROUP BY p.packet_id""", ALL_FOUND))
def lint_gate(spark, sf):
    found = all_findings(spark, sf)
    counts = found.groupBy("packet_id").agg(
        F.count_if(L.is_error() & (F.col("code") != "SL002")).alias("errors"),
        F.count_if(F.col("code") == "SL002").alias("schema_errors"),
    )
    return packet_set(spark, sf).packets.select("packet_id").join(
        counts, "packet_id", "left"
    ).na.fill(0).withColumn("passed", (F.col("errors") == 0) & (F.col("schema_errors") == 0))


@query("lint_report", check_sql(REPORT, ALL_FOUND))
def lint_report(spark, sf):
    return L.lint_report(packet_set(spark, sf).packets, all_findings(spark, sf))
