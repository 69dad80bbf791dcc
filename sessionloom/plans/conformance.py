"""Expected shapes and rule codes against what packets really hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.packets import PacketSet


def leaves(ps: PacketSet, scalars: list[str], lists: dict[str, list[str]]) -> DataFrame:
    """Packets as `packet_id, path, value` rows; list items are named by place."""
    parts = [ps.packets.select("packet_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("path"), F.col(s).cast("string").alias("value")) for s in scalars])))]
    for name, cols in lists.items():
        parts.append(getattr(ps, name).select("packet_id", F.inline(F.array(*[
            F.struct(F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit(f"].{c}"))
                     .alias("path"), F.col(c).cast("string").alias("value")) for c in cols]))))
    return reduce(DataFrame.unionByName, parts)


def shape_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected leaves (`packet_id, path, value`) that are missing or different."""
    have = actual.select("packet_id", "path", F.col("value").alias("actual"))
    return expected.join(have, ["packet_id", "path"], "left").where(
        ~F.col("value").eqNullSafe(F.col("actual"))
    ).select("packet_id", "path", F.col("value").alias("expected"), "actual")


def missing_codes(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected rule codes that no finding of the packet has."""
    return expected.select("packet_id", "code").join(
        findings.select("packet_id", "code"), ["packet_id", "code"], "left_anti")


def summary(cases: DataFrame, mismatches: DataFrame, missing: DataFrame) -> DataFrame:
    bad = mismatches.select("packet_id").unionByName(missing.select("packet_id")).distinct()
    return cases.select("packet_id").join(
        bad.withColumn("bad", F.lit(True)), "packet_id", "left"
    ).agg(
        F.count_if(F.col("bad").isNull()).alias("passed"), F.count_if("bad").alias("failed"),
        F.count("*").alias("total"),
    )
