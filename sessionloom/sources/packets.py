"""Packet documents: tolerant scan, typed rows, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.session import allow_repeated_keys

PACKET = """
  schema_version string, id string, title string, status string, validation_level string,
  task_type string, objective string, current_state string, next_action string,
  open_questions array<struct<id: string, text: string, blocking: boolean, status: string>>,
  confidence_score double,
  repo_context struct<attached: boolean, root: string, vcs: string, branch: string,
    base_branch: string, commit: string, base_commit: string, dirty: boolean>,
  context_items array<struct<kind: string, ref: string, reason: string, priority: bigint,
    freshness_score: double, exists: boolean, provenance_refs: array<string>>>,
  constraints array<struct<id: string, type: string, text: string, severity: string,
    source: string, provenance_refs: array<string>>>,
  attempts array<struct<id: string, tool: string, summary: string, result: string,
    failure_reason: string, artifact_refs: array<string>, created_at: string>>,
  acceptance_criteria array<struct<id: string, text: string, status: string, required: boolean,
    source: string, provenance_refs: array<string>>>,
  warnings array<struct<code: string, severity: string, message: string, blocking: boolean,
    source: string>>,
  provenance_links array<struct<id: string, field_name: string, artifact_id: string,
    source_type: string, ref: string, span_start: bigint, span_end: bigint, excerpt: string>>,
  source_artifacts array<struct<id: string, type: string, source_tool: string, uri: string,
    digest: string, created_at: string>>,
  policy struct<approval_required: boolean, dispatch_allowed: boolean, stale_context: boolean,
    reasons: array<string>>,
  render_hints struct<default_target: string, context_budget: bigint, include_provenance: boolean>,
  extensions string, created_at string, updated_at string
"""

# Top-level fields: JSON type and whether they must be present (fixed values).
TOP_LEVEL: dict[str, tuple[str, bool]] = {
    **{n: ("string", True) for n in (
        "schema_version", "id", "title", "status", "validation_level", "task_type", "objective",
        "current_state", "next_action", "created_at", "updated_at")},
    **{n: ("array", True) for n in (
        "open_questions", "context_items", "constraints", "attempts", "acceptance_criteria",
        "warnings", "provenance_links", "source_artifacts")},
    "confidence_score": ("number", True),
    "repo_context": ("object", True),
    "policy": ("object", False),
    "render_hints": ("object", False),
    "extensions": ("object", False),
}


def read_documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Packet files as `uri, doc`: one file is one document."""
    return spark.read.options(**options).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("uri"), F.col("value").alias("doc")
    )


def json_type(v: Column) -> Column:
    """JSON type of a variant; NULL for a missing value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
        .when(s.isNotNull(), "number")
    )


def raw_violations(docs: DataFrame, key: str = "uri", doc: str = "doc") -> DataFrame:
    """Presence, type and unknown-key findings on the JSON text.

    These need the raw document: a typed row cannot tell a missing field from a
    null one, or the number 0.5 from the string "0.5".
    """
    allow_repeated_keys(docs.sparkSession)
    v = docs.select(key, doc, F.try_parse_json(doc).alias("v"))
    top = json_type(F.col("v"))
    is_object = F.coalesce(top == "object", F.lit(False))
    checks = []
    for name, (kind, required) in TOP_LEVEL.items():
        found = json_type(F.try_variant_get("v", f"$.{name}", "variant"))
        if required:
            checks.append(F.when(found.isNull(), F.struct(
                F.lit("/").alias("path"),
                F.lit(f"must have required property '{name}'").alias("message"))))
        checks.append(F.when(found.isNotNull() & (found != kind), F.struct(
            F.lit(f"/{name}").alias("path"), F.lit(f"must be {kind}").alias("message"))))
    known = F.array(*[F.lit(n) for n in TOP_LEVEL])
    extra = F.when(
        F.size(F.array_except(F.json_object_keys(F.col(doc)), known)) > 0,
        F.struct(F.lit("/").alias("path"), F.lit("must NOT have additional properties")
                 .alias("message")),
    )
    of_object = F.filter(F.array(*checks, extra), lambda x: x.isNotNull())
    engine = F.array(F.struct(F.lit("/").alias("path"),
                              F.lit("packet is not an object").alias("message")))
    # Rule 004 for a score that is no number, which a typed row cannot hold.
    score = json_type(F.try_variant_get("v", "$.confidence_score", "variant"))
    odd_score = v.where(is_object & score.isin("string", "boolean", "array", "object")).select(
        key, F.lit(f"{K.RULE_PREFIX}004").alias("code"), F.lit("error").alias("severity"),
        F.lit("/confidence_score").alias("path"),
        F.concat(F.lit("confidence_score must be a number (got "),
                 F.when(score == "array", "object").otherwise(score), F.lit(").")).alias("message"))
    return (
        v.withColumn("is_object", is_object)
        .select(key, "is_object", F.inline(F.when(F.col("is_object"), of_object).otherwise(engine)))
        .select(
            key,
            F.when(F.col("is_object"), f"{K.RULE_PREFIX}002").otherwise(f"{K.RULE_PREFIX}-engine")
            .alias("code"),
            F.lit("critical").alias("severity"), "path", "message",
        )
        .unionByName(odd_score)
    )


def list_elements(v: Column, lists: list[str]) -> Column:
    """The elements of several lists of a document as one array of (list, pos, v)."""

    def tagged(name: str) -> Column:
        elements = F.try_variant_get(v, f"$.{name}", "array<variant>")
        return F.transform(elements, lambda x, i: F.struct(F.lit(name).alias("list"), i.cast("bigint").alias("pos"), x.alias("v")))

    none = F.array().cast("array<struct<list:string,pos:bigint,v:variant>>")
    return F.flatten(F.array(*[F.coalesce(tagged(n), none) for n in lists]))


def scan_packets(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(typed nested packets, quarantined documents).

    Quarantined is what is not a JSON object or lacks an id; everything else is
    read field by field, and a field of a wrong type becomes NULL.
    """
    parsed = docs.withColumn("p", F.from_json(doc, PACKET, {"mode": "PERMISSIVE"}))
    good = F.coalesce(
        (json_type(F.try_parse_json(doc)) == "object") & F.col("p.id").isNotNull(), F.lit(False)
    )
    return parsed.where(good).select("p.*"), parsed.where(~good).drop("p")
