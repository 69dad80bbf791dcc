"""Inputs that need Spark-side shaping: session lines, packet sets, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.workload.derived import table

ORDER_STEP = 2**20
TURNS_PER_CHUNK = 1024


def artifact_id(conv) -> F.Column:
    return F.concat(F.lit("conv-"), F.col(conv).cast("string"))


def session_lines(spark: SparkSession, sf_dir: str, fmt: str | None = None) -> DataFrame:
    """All sessions as lines in their own format (the text of each turn is split
    in place; nothing is gathered per session)."""
    blocks = table(spark, sf_dir, "session_blocks")
    heads = table(spark, sf_dir, "session_heads")
    if fmt:
        blocks, heads = blocks.where(F.col("fmt") == fmt), heads.where(F.col("fmt") == fmt)
    end = F.when(F.col("crlf") == 1, "\r").otherwise("")
    body = blocks.select(
        "conv_id", "ord", end.alias("end"), F.posexplode(F.split("block", "\n", -1))
    ).select(
        artifact_id("conv_id").alias("artifact_id"),
        F.floor(F.col("ord") / TURNS_PER_CHUNK).cast("bigint").alias("chunk"),
        (F.col("ord") * ORDER_STEP + F.col("pos")).alias("pos"),
        F.concat("col", "end").alias("line"),
    )
    first = heads.select(
        artifact_id("conv_id").alias("artifact_id"), F.lit(0).cast("bigint").alias("chunk"),
        F.lit(-1).cast("bigint").alias("pos"), F.concat("line", end).alias("line"),
    )
    last = heads.select(
        artifact_id("conv_id").alias("artifact_id"), F.floor((F.col("max_turn") * 4 + 3) / TURNS_PER_CHUNK).cast("bigint").alias("chunk"),
        F.lit(2**62).alias("pos"), F.lit("").alias("line"),
    )
    return body.unionByName(first).unionByName(last)


def packet_set(spark: SparkSession, sf_dir: str):
    from sessionloom.plans.packets import CHILDREN, PacketSet

    return PacketSet(**{n: table(spark, sf_dir, n) for n in ["packets", *CHILDREN]})


def packet_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version events numbered 1, 2, 3... per packet in journal order."""
    from sessionloom.operators.prefix import bucket, prefix_sums

    events = table(spark, sf_dir, "version_events").select(
        "*", F.lit(1).cast("bigint").alias("one"), bucket(F.col("seq")).alias("bucket")
    )
    return prefix_sums(events, ["packet_id"], ["bucket"], ["seq"], {"before": "one"}).select(
        "packet_id", (F.col("before") + 1).alias("version"), "seq", "status", "validation_level",
        "digest", "updated_at",
    )
