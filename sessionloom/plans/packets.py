"""Packet tables: one table of scalars and one table per list.

A packet is a nested record, but its lists may be of any length, so they live in
tables of their own keyed by `packet_id` and `pos` (place in the list). All plans
work on these tables; nested packets are exploded into them once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import constants as K
from sessionloom.sources import packets as sources

CHILDREN = [
    "questions", "context_items", "constraints", "attempts", "criteria", "warnings",
    "provenance_links", "source_artifacts",
]


@dataclass
class PacketSet:
    packets: DataFrame
    questions: DataFrame
    context_items: DataFrame
    constraints: DataFrame
    attempts: DataFrame
    criteria: DataFrame
    warnings: DataFrame
    provenance_links: DataFrame
    source_artifacts: DataFrame

    def restricted_to(self, ids: DataFrame) -> PacketSet:
        """Only the packets whose `packet_id` is in `ids`."""
        keep = ids.select("packet_id").distinct()
        return PacketSet(**{
            n: getattr(self, n).join(keep, "packet_id", "left_semi")
            for n in ["packets", *CHILDREN]
        })


# List fields of a nested packet and the child table they become.
NESTED = {
    "open_questions": "questions", "context_items": "context_items",
    "constraints": "constraints", "attempts": "attempts", "acceptance_criteria": "criteria",
    "warnings": "warnings", "provenance_links": "provenance_links",
    "source_artifacts": "source_artifacts",
}


def from_nested(df: DataFrame) -> PacketSet:
    """Explode nested packet rows (see `sources.packets.PACKET`)."""

    def child(field: str) -> DataFrame:
        rows = df.select(F.col("id").alias("packet_id"), F.posexplode(field).alias("pos", "x"))
        names = df.schema[field].dataType.elementType.fieldNames()
        cols = [F.col("packet_id"), F.col("pos").cast("bigint").alias("pos")]
        for n in names:
            if n in ("provenance_refs", "artifact_refs"):
                size = F.coalesce(F.size(F.col(f"x.{n}")), F.lit(0))
                cols.append(F.greatest(size, F.lit(0)).cast("bigint").alias("n_refs"))
                cols.append(F.col(f"x.{n}").alias("refs"))
            else:
                cols.append(F.col(f"x.{n}").alias(n))
        return rows.select(*cols)

    repo = [F.col(f"repo_context.{n}").alias(n) for n in
            ("attached", "root", "vcs", "branch", "base_branch", "commit", "base_commit", "dirty")]
    core = df.select(
        F.col("id").alias("packet_id"), "schema_version", "title", "status", "validation_level",
        "task_type", "objective", "current_state", "next_action", "confidence_score", *repo,
        F.col("policy").isNotNull().alias("has_policy"),
        F.col("policy.approval_required").alias("approval_required"),
        F.col("policy.dispatch_allowed").alias("dispatch_allowed"),
        F.array_join("policy.reasons", "; ").alias("policy_reasons"),
        F.col("render_hints.context_budget").cast("bigint").alias("context_budget"),
        F.col("render_hints.include_provenance").alias("include_provenance"),
        "created_at", "updated_at", F.col("repo_context.root").alias("repo"),
    )
    return PacketSet(packets=core, **{t: child(f) for f, t in NESTED.items()})


def write_lists(docs: DataFrame, path: str, doc: str = "doc") -> None:
    """Write the lists of all packet documents in one scan: an element is a row of its
    packet's id, its place and its JSON value, in a folder per list."""
    parsed = docs.select(F.try_parse_json(doc).alias("d"))
    rows = parsed.select(F.try_variant_get("d", "$.id", "string").alias("packet_id"), F.inline(sources.list_elements(F.col("d"), list(NESTED))))
    rows.where(F.col("packet_id").isNotNull()).write.partitionBy("list").parquet(path)


def read_lists(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The list tables written by `write_lists`, typed (a value of a wrong type is NULL),
    by the name of the list."""
    kinds = T.StructType.fromDDL(sources.PACKET)
    rows = spark.read.schema("packet_id string, pos bigint, v variant, list string").parquet(path)

    def typed(name: str) -> DataFrame:
        fields = kinds[name].dataType.elementType.fields
        values = [F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
        return rows.where(F.col("list") == name).select("packet_id", "pos", *values)

    return {n: typed(n) for n in NESTED}


def count_where(cond: Column) -> Column:
    return cond.cast("bigint")


def list_facts(ps: PacketSet) -> DataFrame:
    """List sizes and rule flags per packet, from one map-side combined aggregate
    over the union of the lists (only the id and a few counters are shuffled)."""
    code_kind = F.col("kind").isin(K.QUALIFYING_KINDS)
    flags = {
        "context_items": {"n_items": F.lit(1), "n_qualifying": code_kind.cast("int")},
        "criteria": {"n_criteria": F.lit(1), "n_required": F.col("required").cast("int")},
        "warnings": {"n_warnings": F.lit(1), "n_blocking": F.col("blocking").cast("int")},
        "questions": {"n_questions": F.lit(1), "n_open": (F.col("status") == "open").cast("int")},
        "constraints": {"n_constraints": F.lit(1)},
        "attempts": {"n_attempts": F.lit(1)},
        "provenance_links": {"n_links": F.lit(1)},
    }
    names = [n for f in flags.values() for n in f]
    union: DataFrame | None = None
    for name, f in flags.items():
        part = getattr(ps, name).select(
            "packet_id", *[f.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]
        )
        union = part if union is None else union.unionByName(part)
    return union.groupBy("packet_id").agg(*[F.sum(n).alias(n) for n in names])


def with_facts(ps: PacketSet) -> DataFrame:
    facts = list_facts(ps)
    return ps.packets.join(facts, "packet_id", "left").na.fill(
        0, [c for c in facts.columns if c != "packet_id"]
    )


def packet_index(ps: PacketSet) -> DataFrame:
    """The ten-column summary of each packet."""
    counts = ps.warnings.groupBy("packet_id").agg(
        F.count("*").alias("warning_count"), F.count_if("blocking").alias("blocking_warning_count")
    )
    return ps.packets.join(counts, "packet_id", "left").select(
        F.col("packet_id").alias("id"), "title", "status", "validation_level", "task_type",
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        F.coalesce("blocking_warning_count", F.lit(0)).alias("blocking_warning_count"),
        "confidence_score", "created_at", "updated_at",
    )
