"""Append-only JSONL journals, read tolerantly in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import full_trim
from sessionloom.session import allow_repeated_keys
from sessionloom.sources.lines import numbered_lines

DISPATCH = (
    "id string, packet_id string, target_tool string, adapter string, status string, "
    "destination string, receipt_json string, created_at string"
)
OUTCOME = (
    "id string, packet_id string, source_tool string, classification string, "
    "outcome_path string, created_at string"
)


def parse_journal(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Rows of journal lines; blank and malformed lines are skipped."""
    allow_repeated_keys(lines.sparkSession)
    return (
        lines.withColumn("__t", full_trim(line))
        .where((F.col("__t") != "") & F.try_parse_json("__t").isNotNull())
        .withColumn("__r", F.from_json("__t", schema))
        .select(*[c for c in lines.columns if c != line], "__r.*")
    )


def read_journal(spark: SparkSession, path: str, schema: str, stream: bool = False, **options: str) -> DataFrame:
    """A journal folder, in batch or as a stream of files. `seq` is the place in the
    journal: file, file split and line (`latest` depends on it, not on time stamps)."""
    reader = spark.readStream.schema("value string") if stream else spark.read
    rows = numbered_lines(reader.options(**options).option("lineSep", "\n").text(path))
    return parse_journal(rows.select("line", F.struct("file", "split", "row").alias("seq")), schema)
