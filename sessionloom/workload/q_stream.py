"""Queries over streams: the given tables arrive as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.session import work_dir
from sessionloom.sources import journals as J
from sessionloom.sources.lines import write_lines
from sessionloom.streaming import jobs
from sessionloom.workload.derived import check_sql
from sessionloom.workload.inputs import session_lines
from sessionloom.workload.q_compile import NOW, nb, title_sql
from sessionloom.workload.q_handoff import ALL_MESSAGES, ENDS
from sessionloom.workload.q_sources import DIGESTS, FILE_LINES, PX
from sessionloom.workload.q_text import LIMIT_RE, PLACEHOLDER
from sessionloom.workload.registry import query


SLICES, FILES = 4, 4


def stream_of(spark, sf, name, order, key, more=None):
    """The table (and the rows `more`) as a file stream of about SLICES micro-batches in
    ascending `order`; the rows of a key and slice are in one of FILES files."""
    given = spark.read.parquet(f"{sf}/{name}.parquet")
    given = given.unionByName(more(given)) if more else given
    place = F.coalesce(F.expr(order), F.lit(0))
    low, high = given.agg(F.min(place), F.max(place)).first()
    low, width = low or 0, (high or 0) - (low or 0) + 1
    folder = work_dir(spark, f"stream-{name}")
    for i in range(SLICES):
        part = given.where(F.least(F.floor((place - low) * SLICES / F.lit(width)), F.lit(SLICES - 1)) == i)
        part.repartition(FILES, key).write.mode("append").parquet(folder)
    return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", str(FILES)).parquet(folder)


CHUNK = """CASE WHEN conv_id % 10 = 0 AND turn = 1 THEN left(text, 55) || ' usage limit ' || substr(text, 56)
  WHEN conv_id % 10 = 4 AND turn >= 1 THEN left(text, 30) || ' Rate-Limit hit ' || substr(text, 31)
  WHEN conv_id % 10 = 7 AND turn = 0 THEN 'usage li' WHEN conv_id % 10 = 7 AND turn = 1 THEN 'mit, ' || text
  ELSE text END AS text"""


@query("stream_limit_markers", check_sql(f"""
SELECT conv_id AS session_id, min(turn) AS seq FROM (
  SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), {K.MARKER_SPAN - 1}), '') || text AS t FROM chunk_texts) c
WHERE regexp_matches(t, '{LIMIT_RE}', 'i') GROUP BY conv_id"""))
def stream_limit_markers(spark, sf):
    chunks = stream_of(spark, sf, "conversations", "turn", "conv_id").selectExpr(
        "conv_id AS session_id", "turn AS seq", CHUNK)
    return jobs.limit_triggers(chunks)


def journal_files(spark, sf):
    """All events as journal files: folders of FILES files each, by name in the order of
    the events; some lines are blank or cut off."""
    given = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "'dis-' || CAST(event_id AS STRING) AS id", "'conv-' || CAST(user_id AS STRING) AS packet_id",
        "CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'delivered' END AS status")
    line = F.to_json(F.struct("id", "packet_id", "status"))
    torn = F.when(F.col("event_id") % 7 == 3, F.concat(line, F.lit("\n\n"), F.left(line, F.lit(15)))).otherwise(line)
    low, high = given.agg(F.min("event_id"), F.max("event_id")).first()
    low, width = low or 0, (high or 0) - (low or 0) + 1
    folder = work_dir(spark, "journal")
    for i in range(SLICES):
        part = given.where(F.floor((F.col("event_id") - low) * SLICES / F.lit(width)) == i)
        part.repartitionByRange(FILES, "event_id").sortWithinPartitions("event_id").select(
            torn.alias("value")).write.text(f"{folder}/slice={i}")
    return folder


@query("stream_latest_events", check_sql("""
SELECT packet_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY seq DESC) AS rn FROM dispatches) d WHERE rn = 1"""))
def stream_latest_events(spark, sf):
    rows = J.read_journal(spark, f"{journal_files(spark, sf)}/slice=*", "id string, packet_id string, status string",
                          stream=True, maxFilesPerTrigger=str(FILES))
    return jobs.latest_events(rows).select("packet_id", "id", "status")


@query("stream_compile", check_sql(f"""
SELECT 'conv-' || conv_id AS packet_id, {title_sql("coalesce(first_user, first_prose, 'conv-' || conv_id)")} AS title,
  coalesce({nb('first_user')}, '{K.DEFAULT_OBJECTIVE}') AS objective,
  coalesce({nb('last_prose')}, {nb('first_prose')}, '{K.DEFAULT_STATE}') AS current_state
FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user,
  arg_min(text, turn) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS first_prose,
  arg_max(text, turn) FILTER (WHERE role = 'assistant' AND NOT ({PLACEHOLDER})) AS last_prose
  FROM conversations GROUP BY conv_id) e"""))
def stream_compile(spark, sf):
    turns = stream_of(spark, sf, "conversations", "turn", "conv_id").selectExpr(
        "conv_id AS session_id", "turn AS ord", "role", "text")
    return jobs.incremental_compile(turns, NOW).select(
        "packet_id", "title", "objective", "current_state")


def _pages_twice(given):
    """A third of the pages arrives again, half a table later."""
    most = given.agg(F.max("page_id")).first()[0] or 0
    return given.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + int(most / 2) + 1)


@query("stream_new_artifacts", check_sql("""
SELECT DISTINCT 'sha256:' || sha256(html) AS digest, strlen(html)::BIGINT AS bytes FROM pages
WHERE html IS NOT NULL AND html NOT IN (SELECT html FROM pages WHERE page_id % 10 = 7 AND html IS NOT NULL)"""))
def stream_new_artifacts(spark, sf):
    known = spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 10 = 7").select(
        F.concat(F.lit("sha256:"), F.sha2("html", 256)).alias("digest"))
    pages = stream_of(spark, sf, "pages", "page_id", "page_id", _pages_twice).where("html IS NOT NULL").select(
        F.timestamp_seconds("page_id").alias("at"), F.col("html").alias("body"))
    return jobs.new_artifacts(pages, known, "at", "10 days").select("digest", F.octet_length("body").cast("bigint").alias("bytes"))


def _tick(given):
    """A last event of nobody, so late that all sessions have ended."""
    return given.orderBy(F.desc("ts")).limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("ts", F.expr("ts + INTERVAL 2 DAYS"))


@query("stream_session_ends", check_sql("""
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS opens
    FROM events) a) b GROUP BY user_id, session"""))
def stream_session_ends(spark, sf):
    events = stream_of(spark, sf, "events", "unix_micros(cast(ts AS timestamp))", "user_id", _tick)
    return jobs.stream_session_ends(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 7200)


def session_folder(spark, sf):
    """All sessions as files, then a fifth of them again as later files of other paths;
    the folder and the number of files."""
    lines = session_lines(spark, sf)
    number = F.substring("artifact_id", 6, 20).cast("bigint")
    folder, files = work_dir(spark, "session-stream"), 0
    for name, part in (("new/", lines), ("again/", lines.where(number % 5 == 2))):
        files += write_lines(part.withColumn("artifact_id", F.concat(F.lit(name), "artifact_id")), folder).count()
    return folder, files


@query("stream_compile_files", check_sql(f"""
SELECT packet_id, {title_sql("coalesce(first_user, first_prose, packet_id)")} AS title,
  coalesce({nb('first_user')}, '{K.DEFAULT_OBJECTIVE}') AS objective,
  coalesce({nb('last_prose')}, {nb('first_prose')}, '{K.DEFAULT_STATE}') AS current_state, digest, n_lines, bytes
FROM ends2 JOIN digests ON artifact_id = packet_id""", {
    **PX, "messages": ALL_MESSAGES, "ends2": ENDS, "file_lines": FILE_LINES, "digests": DIGESTS}))
def stream_compile_files(spark, sf):
    """Session files through detection and parsers, in SLICES micro-batches, oldest files first."""
    folder, files = session_folder(spark, sf)
    drafts = jobs.compile_files(
        spark, f"{folder}/*", NOW, packet_id=F.regexp_extract("artifact_id", r"[^/]*\z", 0),
        maxFilesPerTrigger=str(max(1, -(-files // SLICES))))
    return drafts.select("packet_id", "title", "objective", "current_state", "digest", "n_lines", "bytes")
