"""Streaming forms: limit trigger, new artifacts, session ends, latest state, incremental compile."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionloom import constants as K
from sessionloom.functions.text import has_limit_marker, is_tool_placeholder
from sessionloom.plans.compile import compile_fast
from sessionloom.session import materialize, work_dir
from sessionloom.sources.lines import digests, in_order, numbered_lines
from sessionloom.sources.sessions import parse_sessions

SPAN = K.MARKER_SPAN - 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a small file counts as beside its bytes when files are dealt to tasks.
FILE_COST = "256k"


class BatchLog:
    """An append-only table of micro-batches: batch n writes the folder of batch n
    and nothing else, so a repeated batch replaces its own rows, what a batch writes
    is bounded by its rows, and readers see the batches of all folders."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before one."""
        try:
            rows = spark.read.schema(f"{self.schema}, batch bigint").parquet(self.path)
            return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema)


def run_batches(stream: DataFrame, state_dir: str,
                step: Callable[[DataFrame, int], None]) -> None:
    """Run `step` over all data there is now; `state_dir` makes it resumable."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{state_dir}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


@contextlib.contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Settings for streams of many small files, taken over by streams that start inside.

    Spark looks up each file of a micro-batch by its own path, in a job of one task a
    file, and deals few of them to a task that reads. Here both get as many files a task
    as a shuffle gets rows: tasks follow the cores and bytes, not the files."""
    given = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.files.openCostInBytes": FILE_COST,
    }
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def append_all(stream: DataFrame, state_dir: str, name: str) -> DataFrame:
    """Append the stream's rows of all data there is now to a table, and that table
    with the rows of earlier runs; `state_dir` makes it resumable."""
    path = f"{state_dir}/{name}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class LimitTrigger(StatefulProcessor):
    """Per session: whether it has fired, and the last characters of its output."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # What a "." does not match in the JVM.
        pattern = "|".join(K.LIMIT_MARKERS).replace(".", "[^\\n\\r\\x85\\u2028\\u2029]")
        self.marker = re.compile(pattern, re.IGNORECASE | re.ASCII)
        self.session = handle.getValueState("session", "fired boolean, tail string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired, tail = self.session.get() if self.session.exists() else (False, "")
        given = pd.concat(rows).sort_values("seq")
        if not fired:
            for row in given.itertuples():
                fired = bool(row.hit) or self.marker.search(tail + row.head) is not None
                if fired:
                    yield pd.DataFrame({"session_id": [key[0]], "seq": [row.seq]})
                    break
                tail = (tail + row.tail)[-SPAN:] if row.short else row.tail
            # The last characters of a session that has fired are of no use.
            self.session.update((fired, "" if fired else tail))

    def close(self) -> None:
        pass


def limit_triggers(chunks: DataFrame, state_dir: str | None = None) -> DataFrame:
    """`session_id, seq` of the first limit marker of each session of a stream of
    `session_id, seq, text` with `seq` from 0.

    Chunks are searched where they are; what is sent to a session's state is a few
    characters of each: its first and last ones, so that a marker cut by the border of
    two chunks, or of two micro-batches, still matches. The state of a session (a flag
    and a tail) lives in RocksDB, so a micro-batch writes no more than the sessions that
    it touches. It has no time to live: that needs processing-time batches without end,
    and a run over all data there is now would not stop.
    """
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    text = F.col("text")
    ends = chunks.where(F.char_length("text") > 0).select(
        "session_id", "seq", has_limit_marker(text).alias("hit"), F.left(text, F.lit(SPAN)).alias("head"),
        F.right(text, F.lit(SPAN)).alias("tail"), (F.char_length(text) < SPAN).alias("short"))
    fired = ends.groupBy("session_id").transformWithStateInPandas(LimitTrigger(), "session_id bigint, seq bigint", "Append", "None")
    return append_all(fired, state_dir or work_dir(spark, "limit"), "fired")


def new_artifacts(artifacts: DataFrame, known: DataFrame, at: str, delay: str = "1 hour", state_dir: str | None = None) -> DataFrame:
    """The artifacts (`body`, `at`, more columns) of a stream whose content is new, with
    their `digest`: the same bytes arriving again within `delay` of event time are
    dropped by state, later ones by the digests stored when a run starts (`known` and
    what earlier runs over `state_dir` have stored)."""
    spark = artifacts.sparkSession
    state_dir = state_dir or work_dir(spark, "artifacts")
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256))
    once = artifacts.withColumn("digest", digest).withWatermark(at, delay).dropDuplicatesWithinWatermark(["digest"])
    stored = known.select("digest")
    try:
        stored = stored.union(spark.read.schema(once.schema).parquet(f"{state_dir}/new").select("digest"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return append_all(once.join(stored, "digest", "left_anti"), state_dir, "new")


def stream_session_ends(events: DataFrame, key: str, ts: str, gap_seconds: int, delay: str = "0 seconds", state_dir: str | None = None) -> DataFrame:
    """Activity sessions of an event stream, each appended once it has ended: when the
    watermark (the latest event time less `delay`) is past its last event by the gap.
    State is one row per open session; partial sessions are merged before the shuffle."""
    us = lambda c: F.unix_micros(c)
    ended = events.withWatermark(ts, delay).groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("w"), key).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("events"))
    rows = ended.select(key, us(F.col("lo")).alias("start_us"), us(F.col("hi")).alias("end_us"), "events")
    return append_all(rows, state_dir or work_dir(events.sparkSession, "sessions"), "ended")


def latest_events(journal: DataFrame, state_dir: str | None = None) -> DataFrame:
    """Latest row per packet of a journal stream (`packet_id, seq`, more columns).

    The state, one row per packet in RocksDB, is the result: a micro-batch writes the
    packets it touches, and the state is read back as a table, whose size follows the
    packets and not the batches. `seq` may be a number or a place in journal files.
    """
    spark = journal.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = ["seq", *[c for c in journal.columns if c not in ("packet_id", "seq")]]
    state_dir = state_dir or work_dir(spark, "latest")
    query = (
        journal.groupBy("packet_id").agg(F.max(F.struct(*names)).alias("x"))
        .writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    try:
        state = spark.read.format("statestore").load(f"{state_dir}/checkpoint")
    except Exception as e:  # a stream that never had a row has no state
        if "STDS_" not in str(e):
            raise
        return spark.createDataFrame([], journal.select("packet_id", *names).schema)
    last = state.schema["value"].dataType.fieldNames()[0]
    return state.select("key.packet_id", f"value.{last}.*").select("packet_id", *names)


def incremental_compile(turns: DataFrame, now: str, state_dir: str | None = None) -> DataFrame:
    """Packet drafts of a stream of turns (`session_id, ord, role, text`).

    A batch is reduced to the turns that can matter for a draft: per session the
    first user turn, the first and the last prose turn, with their places. These
    are logged; the drafts are compiled from the log. As the reduction picks turns
    by their place, a turn that arrives twice, or late, changes nothing else.
    """
    spark = turns.sparkSession
    state_dir = state_dir or work_dir(spark, "compile")
    log = BatchLog(f"{state_dir}/turns", "session_id bigint, ord bigint, role string, text string")
    run_batches(turns, state_dir, lambda batch, n: log.write(deciding_turns(batch), n))
    rows = deciding_turns(log.read(spark))
    packet = F.concat(F.lit("conv-"), F.col("session_id").cast("string"))
    sessions = rows.select("session_id").distinct().withColumn("packet_id", packet)
    return compile_fast(rows, sessions, now=now)


def compile_files(spark: SparkSession, path: str, now: str, known: DataFrame | None = None,
                  packet_id: Column | None = None, state_dir: str | None = None, **options: str) -> DataFrame:
    """Packet drafts of session files as they arrive in a folder, one for each content.

    Columns of the drafts, and `digest, n_lines, bytes` of the file. A micro-batch reads
    its files by split, drops those whose digest is in `known`, was stored by an earlier
    batch or belongs to a smaller path of the batch, and sends the rest through format
    detection and the parsers; it logs their digests and deciding turns, nothing else.
    A batch that is run again looks at the batches before it alone and replaces its own
    rows. `packet_id` is made from `artifact_id`, the path (default: the path itself).
    A file of no bytes has no line and gives no packet.
    """
    state_dir = state_dir or work_dir(spark, "compile-files")
    turns = BatchLog(f"{state_dir}/turns", "session_id string, ord bigint, role string, text string")
    files = BatchLog(f"{state_dir}/files", "artifact_id string, n_lines bigint, bytes bigint, digest string")
    reader = spark.readStream.schema("value string").options(**options).option("lineSep", "\n")
    arriving = numbered_lines(reader.text(path))

    def step(batch: DataFrame, n: int) -> None:
        # Read by the caller's session, whose settings hold for the plans below; that of
        # a stream may plan without AQE.
        arrived = work_dir(spark, "arrived")
        batch.write.parquet(arrived)
        lines = in_order(spark.read.schema(batch.schema).parquet(arrived))
        seen = files.read(spark, before=n).select("digest")
        if known is not None:
            seen = seen.unionByName(known.select("digest"))
        first = digests(lines).groupBy("digest").agg(F.min(F.struct("artifact_id", "n_lines", "bytes")).alias("x"))
        fresh = materialize(first.select("x.*", "digest").join(seen, "digest", "left_anti"), "fresh")
        parsed = parse_sessions(lines.join(fresh, "artifact_id", "left_semi"))
        turns.write(deciding_turns(parsed.withColumnRenamed("artifact_id", "session_id")), n)
        files.write(fresh, n)

    with many_files(spark):
        run_batches(arriving, state_dir, step)
    rows = deciding_turns(turns.read(spark))
    stored = files.read(spark).withColumnRenamed("artifact_id", "session_id")
    name = F.col("artifact_id") if packet_id is None else packet_id
    sessions = files.read(spark).select(F.col("artifact_id").alias("session_id"), name.alias("packet_id"))
    return compile_fast(rows, sessions, now=now).join(stored, "session_id")


def deciding_turns(turns: DataFrame) -> DataFrame:
    """At most four turns of each session: the first user turn, the first and the
    last prose turn, and one that stands for a session without these."""
    user = F.col("role") == "user"
    prose = (F.col("role") == "assistant") & ~is_tool_placeholder(F.col("text"))
    turn = F.struct("ord", "role", "text")
    ends = turns.groupBy("session_id").agg(F.array(
        F.min(turn), F.min(F.when(user, turn)), F.min(F.when(prose, turn)), F.max(F.when(prose, turn))).alias("found"))
    return ends.select("session_id", F.inline(F.array_distinct(F.filter("found", lambda x: x.isNotNull()))))
