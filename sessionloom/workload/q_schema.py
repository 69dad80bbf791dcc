"""Packet documents with filled lists, their schema findings and their list tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from sessionloom.plans import document_schema as D
from sessionloom.plans.packets import read_lists, write_lists
from sessionloom.session import materialize, work_dir
from sessionloom.sources import packets as P
from sessionloom.workload import derived
from sessionloom.workload.derived import check_sql, escaped, table, text
from sessionloom.workload.registry import query

N = "CAST(substr(packet_id, 6) AS BIGINT)"
K41 = f"({N} * 5 + pos) % 41"


def _str(name: str, value: str, odd: dict[int, str] | None = None) -> str:
    """A JSON member; for some elements its raw text is another."""
    arms = " ".join(f"WHEN {k} THEN '{raw}'" for k, raw in (odd or {}).items())
    plain = f"'\"' || {escaped(value)} || '\"'"
    return f"'\"{name}\":' || " + (f"CASE {K41} {arms} ELSE {plain} END" if arms else plain)


def _raw(name: str, value: str, odd: dict[int, str] | None = None) -> str:
    arms = " ".join(f"WHEN {k} THEN '{raw}'" for k, raw in (odd or {}).items())
    plain = f"coalesce({text(value)}, 'null')"
    return f"'\"{name}\":' || " + (f"CASE {K41} {arms} ELSE {plain} END" if arms else plain)


def _element(listed: str, source: str, members: list[str], whole: str = "", lack: str = "") -> str:
    """Elements of one list; `whole` stands for element 6, and element 9 lacks the last member."""
    *some, last = members
    body = " || ',' || ".join(some)
    full = f"'{{' || {body} || CASE WHEN {K41} = 9 THEN '' ELSE ',' || {last} END || CASE WHEN {K41} = 4 THEN ',\"more\":1' ELSE '' END || '}}'"
    if whole:
        full = f"CASE WHEN {K41} = 6 THEN '{whole}' ELSE {full} END"
    return f"SELECT packet_id, '{listed}' AS list, pos, {full} AS j FROM {source}"


REFS = "CASE WHEN n_refs = 0 THEN '[]' ELSE '[\"r-1\",\"r-2\"]' END"
ITEMS = {
    "open_questions": ("questions", [_str("id", "id", {1: '"Q x"'}), _str("text", "text", {5: '""'}), _raw("blocking", "blocking", {3: '"yes"'}),
                                     _str("status", "status", {2: '"maybe"', 7: "7"})], '"only a text"'),
    "context_items": ("context_items", [_str("kind", "kind", {8: '"page"'}), _str("ref", "ref", {5: '""'}), _str("reason", "reason"),
                                        _raw("priority", "priority", {0: "9", 1: "2.5", 2: "2.0", 3: '"2"'}),
                                        _raw("freshness_score", "freshness_score", {7: "1.5", 10: "-0.5"}), _raw("exists", "NULL", {11: '"no"', 12: "true"}),
                                        _raw("provenance_refs", REFS, {13: '[7,"BAD ID"]', 14: '"r-1"', 15: "[null]"})], "null"),
    "constraints": ("constraints", [_str("id", "id"), _str("type", "type", {1: '"law"'}), _str("text", "text", {2: "null"}), _str("severity", "severity"),
                                    _str("source", "source", {3: '"moon"'}), _raw("provenance_refs", REFS)], "[]"),
    "attempts": ("attempts", [_str("id", "id"), _str("tool", "tool", {1: '""'}), _str("summary", "summary"), _str("result", "result", {2: "false"}),
                              _raw("failure_reason", "NULL", {3: '"broke"', 5: "3"}), _raw("artifact_refs", REFS),
                              _str("created_at", "created_at", {7: '"yesterday"'})], "7"),
    "acceptance_criteria": ("criteria", [_str("id", "id"), _str("text", "text"), _str("status", "status", {1: '"done"'}),
                                         _raw("required", "required", {2: "1", 3: "null"}), _str("source", "source"), _raw("provenance_refs", REFS)], "true"),
    "warnings": ("warnings", [_str("code", "code", {1: '"low"'}), _str("severity", "severity", {2: '"dire"'}), _str("message", "message"),
                              _raw("blocking", "blocking"), _str("source", "source")], ""),
    "provenance_links": ("provenance_links", [_str("id", "id"), _str("artifact_id", "artifact_id"), _str("source_type", "source_type", {2: '"rumour"'}),
                                              _str("ref", "ref"), _raw("span_start", "span_start", {1: "-1", 3: '"x"', 5: "1.5"}),
                                              _raw("span_end", "span_end"), _str("field_name", "field_name", {7: '""'})], "{}"),
    "source_artifacts": ("source_artifacts", [_str("id", "id"), _str("type", "type"), _str("source_tool", "source_tool"), _str("uri", "uri"),
                                              _str("digest", "digest", {1: '"short"'}), _str("created_at", "created_at")], ""),
}
derived.add("raw_items", " UNION ALL ".join(_element(n, *spec) for n, spec in ITEMS.items()))

SCALARS = ["schema_version", "title", "status", "validation_level", "task_type", "current_state", "next_action", "created_at", "updated_at"]
REPO = " || ',' || ".join([
    f"CASE WHEN {N} % 15 = 3 THEN '\"vcs\":\"none\"' ELSE '\"attached\":' || {text('attached')} || ',\"vcs\":\"' || vcs || '\"' END",
    f"'\"root\":' || CASE WHEN {N} % 15 = 2 THEN '\"\"' ELSE coalesce('\"' || root || '\"', 'null') END",
    *[f"'\"{c}\":' || coalesce('\"' || {c} || '\"', 'null')" for c in ("branch", "base_branch", "commit", "base_commit")],
    f"'\"dirty\":' || {text('dirty')}"])
derived.add("raw_heads", f"""
SELECT packet_id, '{{"id":"' || packet_id || '",' || {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:{chr(34)}' || {escaped(c)} || '{chr(34)}'" for c in SCALARS)}
  || ',"objective":' || CASE WHEN {N} % 13 = 8 THEN 'null' ELSE '"' || {escaped("coalesce(objective, 'none')")} || '"' END
  || ',"confidence_score":' || {text("confidence_score")}
  || ',"repo_context":' || CASE WHEN {N} % 13 = 9 THEN '"none"' ELSE '{{' || {REPO} || '}}' END
  || CASE WHEN {N} % 13 = 10 THEN ',"policy":{{"approval_required":true,"reasons":["", 5]}}' ELSE '' END
  || CASE WHEN {N} % 13 = 11 THEN ',"render_hints":{{"default_target":"paper","context_budget":3}},"extensions":{{"any":[]}}' ELSE '' END
  || CASE WHEN {N} % 13 = 12 THEN ',"surprise":1,"other":2,"extensions":[]' ELSE '' END || '}}' AS j
FROM packets""")


def packet_documents(spark, sf):
    """Documents put together from heads and elements; some are cut off or are lists,
    some lack a list or have an object in its place."""
    items, heads = table(spark, sf, "raw_items"), table(spark, sf, "raw_heads")
    body = items.groupBy("packet_id", "list").agg(F.array_sort(F.collect_list(F.struct("pos", "j"))).alias("x"))
    lists = body.groupBy("packet_id").agg(F.map_from_entries(F.collect_list(F.struct("list", F.expr("array_join(transform(x, y -> y.j), ',')")))).alias("m"))
    n = F.substring("packet_id", 6, 20).cast("bigint")
    parts = []
    for name in ITEMS:
        values = F.concat(F.lit(f',"{name}":['), F.coalesce(F.element_at("m", name), F.lit("")), F.lit("]"))
        if name == "warnings":
            values = F.when(n % 13 == 4, "").otherwise(values)
        if name == "attempts":
            values = F.when(n % 13 == 6, ',"attempts":{}').otherwise(values)
        parts.append(values)
    doc = F.concat(F.expr("left(j, char_length(j) - 1)"), *parts, F.lit("}"))
    made = heads.join(lists, "packet_id", "left").select("packet_id", F.when(n % 29 == 1, F.expr("left(j, 40)")).when(
        n % 29 == 2, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc).alias("doc"))
    return materialize(made, "packet-documents")


KIND = """CASE json_type({x}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object'
  WHEN 'ARRAY' THEN 'array' ELSE 'number' END"""
SCHEMA = json.dumps(D.schema()).replace("'", "''")
READABLE = f"{N} % 29 NOT IN (1, 2)"
FINDINGS = {
    "whole": f"SELECT '{SCHEMA}'::JSON AS s",
    "elements": f"SELECT packet_id, list, pos, j::JSON AS j FROM raw_items WHERE {READABLE} AND NOT (list = 'warnings' AND {N} % 13 = 4) AND NOT (list = 'attempts' AND {N} % 13 = 6)",
    "heads": f"SELECT packet_id, j::JSON AS j FROM raw_heads WHERE {READABLE}",
    "specs": """SELECT 'packet' AS name, s FROM whole UNION ALL SELECT k, CASE WHEN s->'properties'->k->'items' IS NULL THEN s->'properties'->k
      ELSE s->'properties'->k->'items' END FROM (SELECT s, unnest(json_keys(s, '$.properties')) AS k FROM whole)""",
    "nodes": """SELECT packet_id, 'packet' AS name, '' AS pointer, j FROM heads
      UNION ALL SELECT packet_id, name, '/' || name, j->name FROM heads, (VALUES ('repo_context'), ('policy'), ('render_hints')) t(name) WHERE j->name IS NOT NULL
      UNION ALL SELECT packet_id, list, '/' || list || '/' || pos, j FROM elements""",
    "objects": "SELECT n.*, s FROM nodes n JOIN specs USING (name) WHERE json_type(j) = 'OBJECT'",
    "fields": "SELECT packet_id, name, pointer, j, s, unnest(json_keys(s, '$.properties')) AS field FROM objects",
    "given": """SELECT packet_id, pointer || '/' || field AS path, s->'properties'->field AS f, j->field AS x FROM fields WHERE j->field IS NOT NULL""",
    "inner_items": """SELECT packet_id, path || '/' || i AS path, f->'items' AS f, json_extract(x, '$[' || i || ']') AS x
      FROM (SELECT *, unnest(range(json_array_length(x)::BIGINT)) AS i FROM given WHERE json_type(x) = 'ARRAY' AND f->'items' IS NOT NULL)""",
    "vals": f"""SELECT *, {KIND.format(x='x')} AS kind, x->>'$' AS t, CASE WHEN {KIND.format(x='x')} = 'number' THEN (x->>'$')::DOUBLE END AS d FROM (
      SELECT * FROM given UNION ALL SELECT * FROM inner_items
      UNION ALL SELECT packet_id, '/' || list || '/' || pos, '{{"type":["object"]}}'::JSON, j FROM elements)""",
    "types": """SELECT *, (f->'type')::VARCHAR[] AS types FROM vals""",
    "broken": """
      SELECT packet_id, CASE pointer WHEN '' THEN '/' ELSE pointer END AS path, 'must have required property ''' || field || '''' AS message
        FROM fields WHERE j->field IS NULL AND list_contains((s->'required')::VARCHAR[], field)
        AND NOT (name = 'packet' AND s->'properties'->field->'items' IS NOT NULL)
      UNION ALL SELECT packet_id, CASE pointer WHEN '' THEN '/' ELSE pointer END, 'must NOT have additional properties'
        FROM (SELECT *, unnest(json_keys(j)) AS k FROM objects) WHERE NOT list_contains(json_keys(s, '$.properties'), k)
      UNION ALL SELECT packet_id, path, 'must be ' || array_to_string(types, ',') FROM types
        WHERE types IS NOT NULL AND NOT list_contains(types, kind) AND NOT (list_contains(types, 'integer') AND coalesce(d = floor(d), false))
      UNION ALL SELECT packet_id, path, 'must be equal to constant' FROM types WHERE f->'const' IS NOT NULL AND t <> f->>'const'
      UNION ALL SELECT packet_id, path, 'must be equal to one of the allowed values' FROM types
        WHERE f->'enum' IS NOT NULL AND NOT (kind = 'string' AND list_contains((f->'enum')::VARCHAR[], t))
      UNION ALL SELECT packet_id, path, 'must NOT have fewer than ' || (f->>'minLength') || ' characters' FROM types WHERE kind = 'string' AND length(t) < (f->>'minLength')::INT
      UNION ALL SELECT packet_id, path, 'must NOT have more than ' || (f->>'maxLength') || ' characters' FROM types WHERE kind = 'string' AND length(t) > (f->>'maxLength')::INT
      UNION ALL SELECT packet_id, path, 'must match pattern "' || (f->>'pattern') || '"' FROM types
        WHERE f->'pattern' IS NOT NULL AND kind = 'string' AND NOT regexp_matches(t, f->>'pattern')
      UNION ALL SELECT packet_id, path, 'must match format "date-time"' FROM types
        WHERE f->'format' IS NOT NULL AND kind = 'string' AND TRY_CAST(t AS TIMESTAMP) IS NULL
      UNION ALL SELECT packet_id, path, 'must be >= ' || (f->>'minimum') FROM types WHERE d < (f->>'minimum')::DOUBLE
      UNION ALL SELECT packet_id, path, 'must be <= ' || (f->>'maximum') FROM types WHERE d > (f->>'maximum')::DOUBLE
      UNION ALL SELECT packet_id, path, 'must NOT have fewer than ' || (f->>'minItems') || ' items' FROM types WHERE kind = 'array' AND json_array_length(x) < (f->>'minItems')::INT""",
    "repos": """SELECT packet_id, j->'root' AS root, j->'vcs' AS vcs FROM nodes WHERE name = 'repo_context' AND json_type(j) = 'OBJECT'
      AND (j->'attached' IS NULL OR (j->>'attached') = 'true')""",
    "then_part": f"""
      SELECT packet_id, '/repo_context/root' AS path, 'must be string' AS message FROM repos WHERE root IS NOT NULL AND json_type(root) <> 'VARCHAR'
      UNION ALL SELECT packet_id, '/repo_context/root', 'must NOT have fewer than 1 characters' FROM repos WHERE json_type(root) = 'VARCHAR' AND (root->>'$') = ''
      UNION ALL SELECT packet_id, '/repo_context/vcs', 'must be equal to constant' FROM repos WHERE (vcs->>'$') <> 'git'""",
}


def _bound(sql: str) -> str:
    """JSON paths in brackets, as the checking engine binds arrows loosely."""
    return re.sub(r"\b\w+(?:->>?(?:'[^']*'|\w+))+", r"(\g<0>)", sql)


FINDINGS = {k: v if k == "whole" else _bound(v) for k, v in FINDINGS.items()}


@query("document_schema_findings", check_sql(f"""
SELECT packet_id, 'SL002' AS code, 'critical' AS severity, path, message FROM (
  SELECT * FROM broken UNION ALL SELECT * FROM then_part
  UNION ALL SELECT DISTINCT packet_id, '/repo_context', 'must match "then" schema' FROM then_part
  UNION ALL SELECT packet_id, '/', 'must have required property ''warnings''' FROM packets WHERE {N} % 13 = 4 AND {READABLE}
  UNION ALL SELECT packet_id, '/attempts', 'must be array' FROM packets WHERE {N} % 13 = 6 AND {READABLE})
UNION ALL SELECT packet_id, 'SL-engine', 'critical', '/', 'packet is not an object' FROM packets WHERE NOT ({READABLE})""", FINDINGS))
def document_schema_findings(spark, sf):
    return D.document_findings(packet_documents(spark, sf), "packet_id")


@query("quarantined_packets", check_sql(f"SELECT packet_id FROM packets WHERE NOT ({READABLE})"))
def quarantined_packets(spark, sf):
    _, odd = P.scan_packets(packet_documents(spark, sf))
    return odd.select("packet_id")


def lists_read_back(spark, sf):
    out = work_dir(spark, "sidecars")
    write_lists(packet_documents(spark, sf), out)
    return read_lists(spark, out)


def _get(name: str) -> str:
    return f"CASE WHEN json_type(j->'{name}') = 'NULL' THEN NULL ELSE j->>'{name}' END"


@query("sidecar_links", check_sql(_bound(f"""
SELECT packet_id, pos, {_get('id')} AS id, {_get('field_name')} AS field_name, {_get('artifact_id')} AS artifact_id, {_get('ref')} AS ref,
  CASE WHEN contains(j->>'span_start', '.') THEN 1 ELSE TRY_CAST(j->>'span_start' AS BIGINT) END AS span_start, TRY_CAST(j->>'span_end' AS BIGINT) AS span_end
FROM elements WHERE list = 'provenance_links'"""), {k: FINDINGS[k] for k in ("elements",)}))
def sidecar_links(spark, sf):
    return lists_read_back(spark, sf)["provenance_links"].select(
        "packet_id", "pos", "id", "field_name", "artifact_id", "ref", "span_start", "span_end")


@query("sidecar_counts", check_sql("SELECT list, count(*) AS n, count(DISTINCT packet_id) AS packets, sum(pos)::BIGINT AS places FROM elements GROUP BY list",
                                   {k: FINDINGS[k] for k in ("elements",)}))
def sidecar_counts(spark, sf):
    back = lists_read_back(spark, sf)
    parts = [rows.groupBy(F.lit(name).alias("list")).agg(
        F.count("*").alias("n"), F.countDistinct("packet_id").alias("packets"), F.sum("pos").alias("places")) for name, rows in back.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


