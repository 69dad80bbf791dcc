"""The rule set as a findings table.

A rule is a condition over one packet table. All rules of a table are evaluated
in one projection over it, so the row-level rules need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions import secrets as X
from sessionloom.functions.text import full_trim, unsafe_ref
from sessionloom.operators.prefix import bucket
from sessionloom.plans.packets import PacketSet, with_facts

FINDING = ["packet_id", "code", "severity", "path", "message"]


@dataclass(frozen=True)
class Rule:
    """`table` is a PacketSet table; `packets` rows also carry the list facts."""

    number: str
    severity: str
    table: str
    when: Callable[[], Column]
    message: Callable[[], Column]
    path: Callable[[], Column]
    fail_in_strict: bool = True

    @property
    def code(self) -> str:
        return f"{K.RULE_PREFIX}{self.number}"


def c(name: str) -> Column:
    return F.col(name)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _item(field: str, tail: str = "") -> Callable[[], Column]:
    return lambda: text(f"/{field}/", c("pos"), tail)


def _fixed(path: str) -> Callable[[], Column]:
    return lambda: F.lit(path)


def _js_number(v: Column) -> Column:
    """Whole numbers without a fraction part, as the messages print them."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _is_code() -> Column:
    return c("task_type").isin(K.CODE_TASK_TYPES)


def _exported() -> Column:
    return c("status").isin("ready_for_export", "dispatched")


def _narrative(field: str) -> Rule:
    return Rule(
        "003", "error", "packets",
        lambda: F.coalesce(full_trim(c(field)) == "", F.lit(True)),
        lambda: F.lit(f"Required narrative field '{field}' is missing or empty."),
        _fixed(f"/{field}"),
    )


RULES: list[Rule] = [
    Rule("001", "critical", "packets",
         lambda: ~c("schema_version").eqNullSafe(K.SCHEMA_VERSION),
         lambda: text(f"schema_version must equal '{K.SCHEMA_VERSION}' (got ",
                      F.coalesce(text("'", c("schema_version"), "'"), F.lit("undefined")), ")."),
         _fixed("/schema_version")),
    _narrative("objective"),
    _narrative("current_state"),
    _narrative("next_action"),
    Rule("004", "error", "packets",
         lambda: ~c("confidence_score").between(0, 1),
         lambda: text("confidence_score must be between 0 and 1 (got ",
                      _js_number(c("confidence_score")), ")."),
         _fixed("/confidence_score")),
    Rule("010", "error", "packets",
         lambda: _is_code() & ~F.coalesce(c("attached"), F.lit(False)),
         lambda: text("task_type='", c("task_type"), "' requires repo_context.attached=true (got ",
                      F.coalesce(c("attached").cast("string"), F.lit("undefined")), ")."),
         _fixed("/repo_context/attached")),
    Rule("011", "error", "packets",
         lambda: _is_code() & (c("n_qualifying") == 0),
         lambda: text("task_type='", c("task_type"), "' requires at least one context_item with "
                      "kind in {file,test,diff,log,issue}."),
         _fixed("/context_items")),
    Rule("020", "error", "packets",
         lambda: _is_code() & (c("n_required") == 0),
         lambda: text("task_type='", c("task_type"), "' requires at least one ",
                      F.when(c("n_criteria") == 0,
                             "required acceptance_criteria entry (none present).")
                      .otherwise("acceptance_criteria entry with required=true.")),
         _fixed("/acceptance_criteria")),
    Rule("041", "error", "packets",
         lambda: _exported() & ~c("validation_level").eqNullSafe("ready"),
         lambda: text('Status "', c("status"), '" requires validation_level "ready", got "',
                      c("validation_level"), '".'),
         _fixed("/validation_level")),
    Rule("042", "error", "packets",
         lambda: c("has_policy") & c("approval_required") & (c("status") == "dispatched")
         & ~F.coalesce(c("approval_granted"), F.lit(False)),
         lambda: F.lit("Packet has policy.approval_required=true but no approval has been "
                       "recorded; dispatch is not permitted."),
         _fixed("/policy/approval_required")),
    Rule("043", "error", "packets",
         lambda: c("has_policy") & ~c("dispatch_allowed") & (c("status") == "dispatched"),
         lambda: text('policy.dispatch_allowed is false but status is "dispatched"; dispatch is '
                      "not permitted.",
                      F.when(c("policy_reasons") != "",
                             text(" Policy reasons: ", c("policy_reasons"), "."))
                      .otherwise("")),
         _fixed("/policy/dispatch_allowed")),
    Rule("021", "error", "questions",
         lambda: c("blocking") & (c("status") == "open"),
         lambda: text("open_question '", F.coalesce(c("id"), text("index ", c("pos"))),
                      "' is blocking and still open; packet cannot be ready."),
         _item("open_questions")),
    Rule("030", "error", "constraints",
         lambda: c("n_refs") == 0,
         lambda: text("constraint '", F.coalesce(c("id"), text("index ", c("pos"))),
                      "' has no provenance_refs."),
         _item("constraints", "/provenance_refs")),
    Rule("031", "warning", "attempts",
         lambda: (c("result") == "failed") & (c("n_refs") == 0),
         lambda: text("failed attempt '", F.coalesce(c("id"), text("index ", c("pos"))),
                      "' has no artifact_refs evidencing the failure."),
         _item("attempts", "/artifact_refs")),
    Rule("032", "warning", "criteria",
         lambda: c("source").isin("user", "ticket") & (c("n_refs") == 0),
         lambda: text("acceptance_criterion '", F.coalesce(c("id"), text("index ", c("pos"))),
                      "' (source='", c("source"), "') has no provenance_refs."),
         _item("acceptance_criteria", "/provenance_refs")),
    Rule("033", "warning", "context_items",
         lambda: (c("priority") >= 4) & (c("n_refs") == 0),
         lambda: text("high-priority context_item '", F.coalesce(c("ref"), text("index ", c("pos"))),
                      "' (priority=", c("priority"), ") has no provenance_refs."),
         _item("context_items", "/provenance_refs")),
]

STRICT = {r.code for r in RULES if r.fail_in_strict} | {
    f"{K.RULE_PREFIX}{n}" for n in ("002", "012", "013", "014", "040", "050", "060")
}

# Fields searched for secrets, by table: (column, path of the field).
SECRET_FIELDS: dict[str, list[tuple[str, str]]] = {
    "packets": [("objective", "/objective"), ("current_state", "/current_state"),
                ("next_action", "/next_action")],
    "questions": [("text", "/open_questions/{}/text")],
    "context_items": [("reason", "/context_items/{}/reason")],
    "constraints": [("text", "/constraints/{}/text")],
    "attempts": [("summary", "/attempts/{}/summary"),
                 ("failure_reason", "/attempts/{}/failure_reason")],
    "criteria": [("text", "/acceptance_criteria/{}/text")],
    "provenance_links": [("excerpt", "/provenance_links/{}/excerpt")],
}


def _evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    hits = F.filter(
        F.array(*[
            F.when(F.coalesce(r.when(), F.lit(False)), F.struct(
                F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"),
                r.path().alias("path"), r.message().alias("message")))
            for r in rules
        ]),
        lambda x: x.isNotNull(),
    )
    return df.select("packet_id", F.inline(hits))


def row_findings(ps: PacketSet, approvals: DataFrame | None = None,
                 rules: list[Rule] | None = None) -> DataFrame:
    """Findings of the rules that look at one packet only."""
    rules = RULES if rules is None else rules
    core = with_facts(ps)
    if approvals is None:
        core = core.withColumn("approval_granted", F.lit(False))
    else:
        granted = approvals.groupBy("packet_id").agg(F.lit(True).alias("approval_granted"))
        core = core.join(granted, "packet_id", "left")
    ready = ps.packets.where(
        (F.col("validation_level") == "ready") | F.col("status").isin(K.READY_STATUSES)
    ).select("packet_id")
    tables: dict[str, DataFrame] = {"packets": core}
    parts = []
    for name in dict.fromkeys(r.table for r in rules):
        df = tables.get(name, getattr(ps, name))
        found = _evaluate(df, [r for r in rules if r.table == name])
        if name == "questions":
            found = found.join(ready, "packet_id", "left_semi")
        parts.append(found.select(*FINDING))
    parts.append(blocking_warning_findings(ps))
    parts.append(secret_findings(ps))
    return reduce(DataFrame.unionByName, parts)


def blocking_warning_findings(ps: PacketSet) -> DataFrame:
    """Rule 050: one finding per gated packet. The codes of a bucket of warnings
    are joined first, then those of the packet's buckets."""
    gated = ps.packets.where(_exported()).select("packet_id", "status")
    listed = lambda order, of: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda x: x[of]), ", ")
    parts = ps.warnings.where("blocking").groupBy(
        "packet_id", bucket(F.col("pos")).alias("part")
    ).agg(listed("pos", "code").alias("codes"), F.count("*").alias("n"))
    whole = parts.groupBy("packet_id").agg(
        listed("part", "codes").alias("codes"), F.sum("n").alias("n_blocking"))
    return whole.join(gated, "packet_id").select(
        "packet_id", F.lit(f"{K.RULE_PREFIX}050").alias("code"), F.lit("error").alias("severity"),
        F.lit("/warnings").alias("path"),
        text('Status "', c("status"), '" is gated by ', c("n_blocking"), " blocking warning(s): ",
             c("codes"), ".").alias("message"),
    )


def secret_findings(ps: PacketSet, fields: dict[str, list[tuple[str, str]]] = SECRET_FIELDS,
                    threshold: float = K.ENTROPY_THRESHOLD) -> DataFrame:
    """Rule 060 over the text fields of packets."""
    texts = []
    for name, cols in fields.items():
        df = getattr(ps, name)
        found = F.array(*[
            F.struct(_path(path).alias("path"), c(col).alias("text")) for col, path in cols
        ])
        texts.append(df.select("packet_id", F.inline(found)))
    return (
        reduce(DataFrame.unionByName, texts)
        .where(X.may_hold_secret("text"))
        .select("packet_id", "path", F.explode(X.secret_hits("text", threshold)).alias("hit"))
        .select("packet_id", F.lit(f"{K.RULE_PREFIX}060").alias("code"),
                F.lit("critical").alias("severity"), "path",
                text("Apparent secret (", c("hit.kind"), ") at offset ", c("hit.offset"), ".")
                .alias("message"))
    )


def _path(template: str) -> Column:
    before, mark, after = template.partition("{}")
    return text(before, c("pos"), after) if mark else F.lit(template)


def repo_items(ps: PacketSet, kinds: list[str]) -> DataFrame:
    repos = ps.packets.where("attached").select("packet_id", "repo")
    return (
        ps.context_items.where(F.col("kind").isin(kinds) & (F.col("ref") != ""))
        .select("packet_id", "pos", "kind", "ref")
        .join(repos, "packet_id")
    )


def missing_files(ps: PacketSet, inventory: DataFrame) -> DataFrame:
    """Rule 012: files and directories that are unsafe or not in the inventory.

    Repositories without an inventory are skipped.
    """
    known = inventory.select("repo").distinct()
    items = repo_items(ps, K.FILE_KINDS).join(known, "repo", "left_semi").withColumn(
        "problem", unsafe_ref(c("ref"))
    )
    unsafe = items.where(c("problem").isNotNull()).withColumn(
        "message",
        F.when(c("problem") == "absolute", "context_item.ref must be a repo-relative path; "
               "absolute paths are not allowed")
        .otherwise("context_item.ref must not traverse outside the repo"),
    )
    missing = (
        items.where(c("problem").isNull())
        .join(inventory.select("repo", F.col("path").alias("ref")), ["repo", "ref"], "left_anti")
        .withColumn("message", text("context_item[", c("pos"), "] references missing ", c("kind"),
                                    ": '", c("ref"), "'."))
    )
    return unsafe.unionByName(missing, allowMissingColumns=True).select(
        "packet_id", F.lit(f"{K.RULE_PREFIX}012").alias("code"), F.lit("error").alias("severity"),
        text("/context_items/", c("pos"), "/ref").alias("path"), "message",
    )


def unresolved_refs(ps: PacketSet, refs: DataFrame) -> DataFrame:
    """Rule 013: branch, commit and base commit that the repository does not know.

    A commit may be abbreviated, so it also matches by its first seven digits
    (the join key) and the rest (a condition on the few rows of that key).
    """
    fields = ["branch", "commit", "base_commit"]
    used = (
        ps.packets.select(
            "packet_id", "repo",
            F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("value"))
                               for f in fields])),
        )
        .where(c("value").isNotNull() & (c("value") != ""))
        .join(refs.select("repo").distinct(), "repo", "left_semi")
    )
    exact = refs.select("repo", F.col("ref").alias("value"))
    commits = refs.where("kind = 'commit'").select(
        F.col("repo").alias("c_repo"), F.left("ref", F.lit(7)).alias("c_head"),
        F.col("ref").alias("c_ref"),
    )
    short = used.join(exact, ["repo", "value"], "left_anti").join(
        commits,
        (c("repo") == c("c_repo")) & (F.left(c("value"), F.lit(7)) == c("c_head"))
        & (F.char_length("value") >= 7) & c("c_ref").startswith(c("value")),
        "left_anti",
    )
    return short.select(
        "packet_id", F.lit(f"{K.RULE_PREFIX}013").alias("code"), F.lit("error").alias("severity"),
        text("/repo_context/", c("field")).alias("path"),
        text("repo_context.", c("field"), "='", c("value"),
             "' does not resolve in the local repo.").alias("message"),
    )


def changed_references(ps: PacketSet, heads: DataFrame, changed: DataFrame) -> DataFrame:
    """Referenced files that changed between a packet's commit and the head."""
    at = (
        ps.packets.where("attached AND commit IS NOT NULL")
        .select("packet_id", "repo", F.col("commit").alias("from_commit"))
        .join(heads.select("repo", F.col("head").alias("to_commit")), "repo")
        .where(c("from_commit") != c("to_commit"))
    )
    items = ps.context_items.where(
        F.col("kind").isin(K.PATH_REF_KINDS) & (F.col("ref") != "")
    ).select("packet_id", "pos", F.col("ref").alias("path"))
    return (
        items.join(at, "packet_id")
        .join(changed.distinct(), ["repo", "from_commit", "to_commit", "path"], "left_semi")
        .select("packet_id", "pos", "path")
    )


def assess_freshness(ps: PacketSet, heads: DataFrame, diffs: DataFrame,
                     changed: DataFrame) -> DataFrame:
    """`packet_id, stale, reason, n_changed` for every packet."""
    pair = ["repo", "from_commit", "to_commit"]
    n_files = changed.groupBy(*pair).agg(F.count("*").alias("n_files"))
    known = diffs.select(*pair).distinct().withColumn("diffed", F.lit(True))
    hits = changed_references(ps, heads, changed).groupBy("packet_id").agg(
        F.count("*").alias("n_changed")
    )
    head = F.when(c("attached"), c("to_commit"))
    base = (
        ps.packets.select("packet_id", "repo", "attached", F.col("commit").alias("from_commit"))
        .join(heads.select("repo", F.col("head").alias("to_commit")), "repo", "left")
        .join(known, pair, "left")
        .join(n_files, pair, "left")
        .join(hits, "packet_id", "left")
    )
    n = F.coalesce(c("n_changed"), F.lit(0))
    reason = (
        F.when(head.isNull(), "repo not attached")
        .when(F.coalesce(c("from_commit"), F.lit("")) == "", "packet has no recorded commit")
        .when(c("from_commit") == head, F.lit(None))
        .when(c("diffed").isNull(), "unable to diff packet commit against HEAD")
        .when(c("n_files").isNull(), "HEAD moved but no files changed")
        .when(n == 0, "HEAD moved but referenced files unchanged")
        .otherwise(text(n, " referenced file", F.when(n == 1, "").otherwise("s"),
                        " changed since packet compiled"))
    )
    return base.select("packet_id", (n > 0).alias("stale"), reason.alias("reason"),
                       n.alias("n_changed"))


def stale_findings(freshness: DataFrame) -> DataFrame:
    """Rule 014."""
    return freshness.where("stale").select(
        "packet_id", F.lit(f"{K.RULE_PREFIX}014").alias("code"),
        F.lit("critical").alias("severity"), F.lit("/repo_context").alias("path"),
        text("Packet is stale against current HEAD",
             F.coalesce(text(" (", c("reason"), ")"), F.lit("")), ".").alias("message"),
    )


def illegal_transitions(versions: DataFrame) -> DataFrame:
    """Rule 040 over `packet_id, version, status`; version numbers may have gaps.

    The prior status comes from the version before in a bucket of versions; the first
    of a bucket gets it from the last status of the bucket before, found among one row
    per bucket. So a packet with a very long history is spread over all tasks.
    """
    rows = versions.where(c("packet_id").isNotNull()).select(
        "packet_id", "version", "status", F.coalesce(bucket(c("version")), F.lit(-1)).alias("bucket"))
    ends = rows.groupBy("packet_id", "bucket").agg(
        F.max(F.struct(c("version").alias("v"), c("status").alias("s")))["s"].alias("last"))
    before = ends.select("packet_id", "bucket", F.lag("last").over(
        Window.partitionBy("packet_id").orderBy("bucket")).alias("edge"))
    inside = Window.partitionBy("packet_id", "bucket").orderBy("version")
    moves = rows.join(before, ["packet_id", "bucket"]).select(
        "packet_id", "version", "status",
        F.when(F.row_number().over(inside) == 1, c("edge")).otherwise(F.lag("status").over(inside)).alias("prior"),
    ).where(~c("status").eqNullSafe(c("prior")) & c("prior").isNotNull())
    allowed = F.create_map(*[
        x for k, v in K.TRANSITIONS.items()
        for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))
    ])
    moves = moves.withColumn("allowed", F.try_element_at(allowed, c("prior")))
    known = c("allowed").isNotNull()
    bad = moves.where(~known | ~F.array_contains(F.coalesce("allowed", F.array().cast(
        "array<string>")), c("status")))
    listed = F.when(F.size("allowed") == 0, "(terminal)").otherwise(F.array_join("allowed", ", "))
    return bad.select(
        "packet_id", "version", F.lit(f"{K.RULE_PREFIX}040").alias("code"),
        F.when(known, "error").otherwise("warning").alias("severity"),
        F.lit("/status").alias("path"),
        F.when(known, text('Illegal status transition: "', c("prior"), '" -> "', c("status"),
                           '". Allowed from "', c("prior"), '": ', listed, "."))
        .otherwise(text('Unknown prior status "', c("prior"), '"; cannot evaluate transition.'))
        .alias("message"),
    )


def is_error(strict: bool = False) -> Column:
    own = F.col("severity").isin("error", "critical")
    return own | F.col("code").isin(list(STRICT)) if strict else own


@dataclass
class RepoState:
    """What rules 012, 013, 014, 040 and 042 need beside the packets; a missing
    table leaves its rule out."""

    inventory: DataFrame | None = None
    refs: DataFrame | None = None
    heads: DataFrame | None = None
    diffs: DataFrame | None = None
    changed: DataFrame | None = None
    versions: DataFrame | None = None
    approvals: DataFrame | None = None


def every_finding(ps: PacketSet, state: RepoState, schema: DataFrame) -> DataFrame:
    """The findings of all rules: those of single packets, of the schema (`schema`,
    see `schema_rules`), of the repository, and the last status change of each packet."""
    parts = [row_findings(ps, state.approvals), schema.select(*FINDING)]
    if state.inventory is not None:
        parts.append(missing_files(ps, state.inventory).select(*FINDING))
    if state.refs is not None:
        parts.append(unresolved_refs(ps, state.refs).select(*FINDING))
    if state.heads is not None:
        fresh = assess_freshness(ps, state.heads, state.diffs, state.changed)
        parts.append(stale_findings(fresh).select(*FINDING))
    if state.versions is not None:
        bad = illegal_transitions(state.versions)
        last = state.versions.groupBy("packet_id").agg(F.max("version").alias("version"))
        parts.append(bad.join(last, ["packet_id", "version"], "left_semi").join(
            ps.packets.select("packet_id"), "packet_id", "left_semi").select(*FINDING))
    return reduce(DataFrame.unionByName, parts)


def lint_report(ids: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row per packet, also for packets without any finding."""
    counts = findings.groupBy("packet_id").agg(
        F.count_if(is_error(strict)).alias("blocking_count"),
        F.count_if(~is_error(strict)).alias("warning_count"),
    )
    n = F.coalesce("blocking_count", F.lit(0))
    return ids.select("packet_id").join(counts, "packet_id", "left").select(
        "packet_id", F.when(n > 0, "failed").otherwise("passed").alias("status"),
        n.alias("blocking_count"), F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
    )


def findings_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("findings"))


# Rules that must be clean for each certification level.
VALID_RULES = ["001", "002", "003", "004"]
VERIFIED_RULES = ["012", "013", "014", "030", "031", "032", "033"]


def certify(ids: DataFrame, findings: DataFrame) -> DataFrame:
    """draft, valid, verified or ready, from the rule groups that are clean."""
    def any_of(numbers: list[str]) -> Column:
        return F.count_if(F.col("code").isin([f"{K.RULE_PREFIX}{n}" for n in numbers]))

    per = findings.groupBy("packet_id").agg(
        any_of(VALID_RULES).alias("bad_valid"), any_of(VERIFIED_RULES).alias("bad_verified"),
        F.count("*").alias("bad_all"),
    )
    return ids.select("packet_id").join(per, "packet_id", "left").select(
        "packet_id",
        F.when(F.col("bad_valid") > 0, "draft").when(F.col("bad_verified") > 0, "valid")
        .when(F.col("bad_all") > 0, "verified").otherwise("ready").alias("level"),
    )
