"""Queries over rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.plans import render as R
from sessionloom.session import work_dir
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.inputs import packet_set
from sessionloom.workload.q_text import sql_trim
from sessionloom.workload.registry import query

N = "chr(10)"
NN = "chr(10) || chr(10)"


def lst(src, item, sep=N, where="true", order="pos"):
    return f"(SELECT string_agg({item}, {sep} ORDER BY {order}) FROM {src} c WHERE c.packet_id = p.packet_id AND {where})"


def sec(head, body, gap=NN):
    """Heading and body, nothing when the body is empty."""
    return f"coalesce({NN} || '{head}' || {gap} || {body}, '')"


def cell(c):
    return f"replace({c}, '|', chr(92) || '|')"


PCT = "CAST(floor(confidence_score * 100 + 0.5) AS BIGINT) || '%'"
CRIT = sec("## Acceptance Criteria", lst("criteria", "'- ' || CASE WHEN status = 'met' THEN '[x]' ELSE '[ ]' END || ' ' || text || CASE WHEN required THEN '' ELSE ' _(optional)_' END"))
QUES = sec("## Open Questions", lst("questions", "'- ' || text || CASE WHEN blocking THEN ' ⚠️ **blocking**' ELSE '' END", where="status = 'open'"))
CONS = sec("## Constraints", lst("constraints", "'- **[' || severity || ']** ' || text"))
ATT = sec("## Prior Attempts", lst("attempts", f"'### ' || (pos + 1) || '. ' || tool || ' — ' || result || {NN} || summary || coalesce({NN} || '_Failure reason:_ ' || failure_reason, '')", sep=NN))


def tick(c):
    return f"coalesce('`' || {c} || '`', 'unknown')"


REPO = f"CASE WHEN attached THEN {NN} || '## Repo' || {NN} || 'Branch: ' || {tick('branch')} || ' · Base: ' || {tick('base_branch')} || ' · Commit: ' || {tick('left(p.commit, 8)')} || ' · ' || CASE WHEN dirty THEN 'Dirty' ELSE 'Clean' END ELSE '' END"
PROV = f"CASE WHEN include_provenance THEN coalesce({NN} || '## Provenance' || {NN} || '| Field | Source type | Ref | Excerpt |' || {N} || '|---|---|---|---|' || {N} || " + lst("provenance_links", f"'| `' || {cell('field_name')} || '` | ' || source_type || ' | `' || {cell('ref')} || '` | ' || {cell(chr(39).join(['coalesce(excerpt, ', '', ')']))} || ' |'") + ", '') ELSE '' END"
STATE = f"{NN} || '## Objective' || {NN} || objective || {NN} || '## Current State' || {NN} || current_state"
NOTE = f"CASE WHEN lim < n_items THEN {NN} || '> _Context list truncated to stay within token budget._' ELSE '' END"
RANKED = "SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY priority, pos) AS rk FROM context_items"
BLOCK = f"'<context priority=\"' || priority || '\">' || {N} || '**' || ref || '** (' || kind || ') — ' || reason || {N} || '</context>'"
FILE = "'  - ' || ref || ' (' || kind || ', p' || priority || ') — ' || reason"
EDIT = "'- `' || ref || '` — ' || reason"
ECONS = sec("## Constraints", lst("constraints", "'- (' || severity || ') ' || text"))
GOAL = f"'## Goal' || {NN} || objective || {NN} || '## Do this next' || {NN} || next_action"
TCTX = (f"'CONTEXT:' || {N} || 'Objective: ' || objective || {N} || 'Current state: ' || current_state || CASE WHEN attached AND "
        "(branch IS NOT NULL OR base_branch IS NOT NULL OR p.commit IS NOT NULL) THEN " + N + " || 'Repo: branch=' || coalesce(branch, 'unknown') || "
        "' base=' || coalesce(base_branch, 'unknown') || ' commit=' || coalesce(left(p.commit, 8), 'unknown') || ' (' || CASE WHEN dirty THEN 'dirty' ELSE 'clean' END || ')' ELSE '' END")
PRE = {
    "generic": f"'# ' || title || {NN} || '**Status:** ' || status || ' · **Confidence:** ' || {PCT} || ' · **Type:** ' || task_type || {STATE} || {NN} || '## Next Action' || {NN} || next_action",
    "claude-code": f"'# {K.APP_NAME} Handoff — ' || title || {NN} || '> **Next action:** ' || next_action || {STATE}",
    "codex": f"'TASK: ' || title || {NN} || {TCTX}",
    "cursor": f"{GOAL} || {ECONS}",
}
FIRST = {"generic": "'| 1 | ' || kind || ' | ' || ref || ' | ' || reason || ' |'", "claude-code": BLOCK, "codex": FILE, "cursor": EDIT}
KEEP = "(lim IS NULL OR rk <= lim)"
BODY = {
    "generic": f"pre || {CRIT} || {QUES} || {CONS} || coalesce({NN} || '## Context' || {NN} || '| Priority | Kind | Path | Reason |' || {N} || '|---|---|---|---|' || {N} || "
               + lst("ranked", f"'| ' || priority || ' | ' || kind || ' | `' || {cell('ref')} || '` | ' || {cell('reason')} || ' |'", where=KEEP, order="rk")
               + f", '') || {ATT} || {REPO} || {PROV} || {NOTE}",
    "claude-code": f"pre || {CRIT} || {QUES} || {CONS} || " + sec("## Context Files", lst("ranked", BLOCK, sep=NN, where=KEEP, order="rk"))
                   + f" || {ATT} || {REPO} || {PROV} || {NN} || '---' || {N} || '_Rendered by {K.APP_NAME} · Confidence: ' || {PCT} || ' · Status: ' || status || '_' || {NOTE}",
    "codex": "'TASK: ' || title || " + sec("FILES:", lst("ranked", FILE, where=KEEP, order="rk"), N) + f" || {NN} || {TCTX} || "
             + sec("ACCEPTANCE CRITERIA:", lst("criteria", "'  ' || (pos + 1) || '. ' || CASE WHEN status = 'met' THEN '[done]' ELSE '[todo]' END || ' ' || text || CASE WHEN required THEN '' ELSE ' (optional)' END"), N) + " || "
             + sec("CONSTRAINTS:", lst("constraints", "'  - [' || severity || '] ' || text"), N) + " || "
             + sec("OPEN QUESTIONS:", lst("questions", "'  - ' || text || CASE WHEN blocking THEN ' (BLOCKING)' ELSE '' END", where="status = 'open'"), N)
             + f" || {NN} || 'NEXT ACTION: ' || next_action || CASE WHEN lim < n_items THEN {NN} || '(Context list truncated to fit token budget.)' ELSE '' END",
    "cursor": f"'## Files' || {NN} || coalesce(" + lst("ranked", EDIT, where=KEEP, order="rk")
              + f", CASE WHEN n_items = 0 THEN '_(none referenced)_' ELSE '_(omitted to fit token budget)_' END) || {NN} || {GOAL} || {ECONS}",
}


def rendered(target):
    """CTEs up to `out`: packet_id, markdown, lim, n_items."""
    return {
        "ranked": RANKED,
        "base": f"SELECT p.* REPLACE (coalesce(objective, 'none') AS objective), {PRE[target]} AS pre, (SELECT count(*) FROM context_items c WHERE c.packet_id = p.packet_id) AS n_items, "
                f"(SELECT CAST(ceil(length({FIRST[target]}) / 4.0) AS BIGINT) FROM ranked c WHERE c.packet_id = p.packet_id AND rk = 1) AS per "
                "FROM (SELECT * REPLACE (coalesce(objective, 'none') AS objective) FROM packets) p",
        "lims": "SELECT *, CASE WHEN context_budget IS NULL THEN NULL WHEN context_budget - ceil(length(pre) / 4.0) <= 0 THEN 0 "
                "ELSE floor((context_budget - ceil(length(pre) / 4.0)) / coalesce(per, 20)) END AS lim FROM base",
        "handed": f"SELECT packet_id, {BODY[target]} AS markdown, lim, n_items FROM lims p",
    }


def packets_of(spark, sf):
    """Packets with a text in every narrative field."""
    ps = packet_set(spark, sf)
    ps.packets = ps.packets.withColumn("objective", F.coalesce("objective", F.lit("none")))
    return ps


def _register(name, target):
    @query(name, check_sql(
        "SELECT packet_id, CAST(0 AS BIGINT) AS part_no, markdown, CAST(length(markdown) AS BIGINT) AS chars FROM handed",
        rendered(target)))
    def run(spark, sf):
        return R.render(packets_of(spark, sf), target)


for _name, _target in (("render_generic", "generic"), ("render_context_blocks", "claude-code"),
                       ("render_task", "codex"), ("render_editor", "cursor")):
    _register(_name, _target)


@query("export_handoffs", check_sql(
    "SELECT packet_id, 'generic' AS target, markdown FROM handed", rendered("generic")))
def export_handoffs(spark, sf):
    """The written handoffs, read back."""
    folder = work_dir(spark, "handoffs")
    R.write_handoffs(R.render(packets_of(spark, sf), "generic").withColumn("target", F.lit("generic")), folder)
    return R.read_handoffs(spark, folder)


@query("budget_limit", check_sql(
    "SELECT packet_id, CAST(lim AS BIGINT) AS item_limit, coalesce(lim < n_items, false) AS truncated FROM lims",
    rendered("generic")))
def budget_limit(spark, sf):
    return R.context_plan(packets_of(spark, sf), R.LAYOUTS["generic"]).select(
        "packet_id", "item_limit", "truncated"
    )


@query("top_context", check_sql(
    "SELECT packet_id, pos, ref, CAST(priority AS BIGINT) AS priority, CAST(rk - 1 AS BIGINT) AS rank FROM ranked WHERE rk <= 3",
    {"ranked": RANKED}))
def top_context(spark, sf):
    return R.ranked_items(table(spark, sf, "context_items")).where("rank < 3").select(
        "packet_id", "pos", "ref", F.col("priority").cast("bigint"), "rank"
    )


@query("dispatch_receipts", check_sql(
    "SELECT packet_id, 'codex' AS target_tool, 'file' AS adapter, CASE WHEN status = 'abandoned' THEN 'failed' ELSE 'delivered' END AS status, "
    "CAST(strlen(markdown) AS BIGINT) AS bytes FROM handed JOIN packets USING (packet_id)", rendered("codex")))
def dispatch_receipts(spark, sf):
    """One receipt per attempt, also for the failed ones."""
    ps = packets_of(spark, sf)
    sizes = R.render_summary(ps, "codex")
    return sizes.join(ps.packets.select("packet_id", "status"), "packet_id").select(
        "packet_id", F.col("target").alias("target_tool"), F.lit("file").alias("adapter"),
        F.when(F.col("status") == "abandoned", "failed").otherwise("delivered").alias("status"),
        "bytes",
    )


@query("context_reduction", check_sql("""
SELECT h.packet_id, CAST(raw AS BIGINT) AS raw_tokens, CAST(ceil(length(markdown) / 4.0) AS BIGINT) AS rendered_tokens,
  CAST(raw - ceil(length(markdown) / 4.0) AS BIGINT) AS tokens_avoided, (raw - ceil(length(markdown) / 4.0)) / raw AS reduction
FROM handed h JOIN (SELECT 'conv-' || conv_id AS packet_id, sum(ceil(length(text) / 4.0)) AS raw FROM turns GROUP BY conv_id) t
  ON t.packet_id = h.packet_id""", rendered("generic")))
def context_reduction(spark, sf):
    turns = table(spark, sf, "turns").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("packet_id"), "text"
    )
    return R.context_reduction(turns, R.render_summary(packets_of(spark, sf), "generic"))


NONE = "'_None._'"
NUM = "CASE WHEN confidence_score = floor(confidence_score) THEN CAST(CAST(confidence_score AS BIGINT) AS VARCHAR) ELSE CAST(confidence_score AS VARCHAR) END"
IDC = f"' <!-- {K.MARKER}:id=' || id || ' -->'"
RO = " || ".join(f"{N} || '- {c}: ' || coalesce(CAST(p.{c} AS VARCHAR), 'null')" for c in
                 ("attached", "root", "vcs", "branch", "base_branch", "commit", "base_commit", "dirty"))
MIRROR = f"""
SELECT packet_id, CAST(0 AS BIGINT) AS part_no, regexp_replace(
  '# ' || title || {NN} || '## Objective' || {NN} || {sql_trim("coalesce(objective, 'none')")} || {NN} || '## Current state' || {NN} || {sql_trim('current_state')}
  || {NN} || '## Next action' || {NN} || {sql_trim('next_action')}
  || {NN} || '## Acceptance criteria' || {NN} || coalesce({lst("criteria", "'- ' || CASE WHEN status = 'met' THEN '[x]' ELSE '[ ]' END || ' ' || text || CASE WHEN required THEN '' ELSE ' _(optional)_' END || " + IDC)}, {NONE})
  || {NN} || '## Constraints' || {NN} || coalesce({lst("constraints", "'- ' || text || " + IDC)}, {NONE})
  || {NN} || '## Open questions' || {NN} || coalesce({lst("questions", "'- [' || status || ']' || CASE WHEN blocking THEN ' (blocking)' ELSE '' END || ' ' || text || " + IDC)}, {NONE})
  || {NN} || '{R.OPEN}' || {N} || '## System-managed metadata' || {NN} || '{R.NOTICE}' || {NN}
  || '- **Confidence score:** ' || {NUM} || {N} || '- **Created at:** ' || created_at || {N} || '- **Updated at:** ' || updated_at || {NN} || '### Repo context' || {N} || {RO}
  || {NN} || '### Source artifacts' || {NN} || coalesce({lst("source_artifacts", "'- `' || id || '` (' || type || ', ' || source_tool || ') — ' || uri")}, {NONE})
  || {NN} || '### Provenance links' || {NN} || coalesce({lst("provenance_links", "'- `' || id || '` ' || field_name || ' ← ' || artifact_id || ' (' || source_type || ')' || coalesce(' [' || span_start || '..' || span_end || ']', '')")}, {NONE})
  || {NN} || '### Warnings' || {NN} || coalesce({lst("warnings", "'- **' || code || '** [' || severity || ']' || CASE WHEN blocking THEN ' (blocking)' ELSE '' END || ' — ' || message")}, {NONE})
  || {N} || '{R.CLOSE}' || {N}, '\\n{{3,}}', {NN}, 'g') AS markdown
FROM packets p"""


@query("render_mirror", check_sql(MIRROR))
def render_mirror(spark, sf):
    return R.render_mirror(packets_of(spark, sf))
