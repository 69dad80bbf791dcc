"""Spark session defaults and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "sessionloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; arguments win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_repeated_keys(spark: SparkSession) -> None:
    """JSON objects with a repeated key are read; the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session without that setting (a test) gets a folder of its own; on
    a cluster the setting must be there, as executors share no other folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sessionloom-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root) if _settable(spark) else None
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _settable(spark: SparkSession) -> bool:
    try:
        return bool(spark.conf.isModifiable("spark.checkpoint.dir"))
    except Exception:
        return False


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and
    the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
