"""Artifacts: registration, content dedup, discovery, import from exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import constants as K

SESSION_PATH = r"/\d+/\d+/\d+/rollout-[^/]*\.jsonl\z"


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Files as `file, bytes, content, ingested_at` (one row per file)."""
    raw = spark.read.format("binaryFile").options(**options).load(path)
    return raw.select(
        F.regexp_extract("path", r"[^/]*\z", 0).alias("file"),
        F.col("length").alias("bytes"), "content",
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ingested_at"),
    )


def register(files: DataFrame, kind: Column, packet_id: Column | None = None) -> DataFrame:
    """Metadata of each file. `content` may be binary or text; an unknown kind is
    rejected by the caller with `known_kind`."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    ext = F.regexp_extract("file", r"[^.]\.([^.]*)\z", 1)
    return files.select(
        F.concat(F.lit("art-"), F.left(F.sha2(F.concat_ws("|", "file", digest), 256), F.lit(16)))
        .alias("artifact_id"),
        kind.alias("kind"), "file",
        F.octet_length("content").cast("bigint").alias("bytes"),
        digest.alias("digest"), ext.alias("extension"),
        (packet_id if packet_id is not None else F.lit(None).cast("string")).alias("packet_id"),
        "ingested_at",
    )


def known_kind(c: Column) -> Column:
    return c.isin(K.ARTIFACT_KINDS)


def dedup(artifacts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One artifact per digest (the first by ingest time and id), without those
    whose digest is already known. Copies are combined map-side, so a digest that
    holds a third of all rows is no hot group."""
    first = artifacts.groupBy("digest").agg(
        F.min(F.struct("ingested_at", *[c for c in artifacts.columns
                                        if c not in ("digest", "ingested_at")])).alias("x")
    ).select("digest", "x.*").select(*artifacts.columns)
    if known is None:
        return first
    return first.join(known.select("digest").distinct(), "digest", "left_anti").select(
        *artifacts.columns
    )


def collected(artifacts: DataFrame) -> DataFrame:
    """Artifacts by packet; rows with a NULL `packet_id` apply to every packet.

    The pairs of shared artifacts and packets are never written out. Use
    `plans.compile.last_transcripts` to see what each packet gets.
    """
    return artifacts.where(known_kind(F.col("kind")))


def unsupported(artifacts: DataFrame) -> DataFrame:
    """Warning rows for the kinds that have no parser."""
    return artifacts.where(F.col("kind") != "transcript").select(
        "packet_id", F.lit("COMPILE_UNSUPPORTED_ARTIFACT").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("Unsupported artifact type for v1 fast mode: "), F.col("kind"),
                 F.lit(" ("), F.col("file"), F.lit(")")).alias("message"),
    )


def latest_session_file(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Path of the newest rollout file under `root/YYYY/MM/DD/`; the content is
    not read (the scan prunes that column)."""
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "rollout-*.jsonl")
        .option("recursiveFileLookup", "true")
    )
    files = reader.load(root).select("path", "modificationTime")
    if since is not None:
        files = files.where(F.col("modificationTime") >= F.lit(since))
    return files.where(F.col("path").rlike(SESSION_PATH)).agg(
        F.max_by("path", "modificationTime").alias("path"),
        F.max("modificationTime").alias("modified"),
    )


def import_external(export: DataFrame, source: str, row_id: Column, url: Column, body: Column,
                    is_transcript: Column) -> DataFrame:
    """Rows of another tool's export as artifacts: transcripts become
    `transcript`, all other rows `note`; the foreign ids go into the uri."""
    return export.select(
        F.concat(F.lit("ext-"), F.left(F.sha2(F.concat_ws("|", F.lit(source), row_id), 256),
                                       F.lit(16))).alias("artifact_id"),
        F.when(is_transcript, "transcript").otherwise("note").alias("kind"),
        F.concat_ws("/", F.lit(f"{source}:"), row_id, F.regexp_replace(url, r"\Ahttps?://", ""))
        .alias("uri"),
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("digest"),
        F.octet_length(body).cast("bigint").alias("bytes"),
    )
