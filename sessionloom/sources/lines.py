"""Line tables: the common input of all session parsers.

Columns: `artifact_id`, `chunk` (non-decreasing with `pos`, holds a bounded
number of lines), `pos` (order within the artifact), `line` (text between two
line feeds, a carriage return kept). A text that ends in a line feed has a last
empty line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.session import materialize

# Lines per chunk when a text column is split (rows of one text stay together).
LINES_PER_CHUNK = 4096
# Hashes below one node of a digest's tree.
DIGEST_FAN = 4096


PLACED = "file string, split bigint, size bigint, line string, row bigint"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each line's number in its split; the lines of a split come in one run."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, split = batch.column(0), batch.column(1)
        opens = np.zeros(n, bool)
        opens[1:] = pc.or_(
            pc.not_equal(file[1:], file[:-1]), pc.not_equal(split[1:], split[:-1])
        ).to_numpy(zero_copy_only=False)
        place = np.arange(n, dtype=np.int64)
        row = place - np.maximum.accumulate(np.where(opens, place, 0))
        if last == (file[0].as_py(), split[0].as_py()):
            row[:np.argmax(opens) if opens.any() else n] += seen
        last, seen = (file[-1].as_py(), split[-1].as_py()), int(row[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(row)], names=[*batch.schema.names, "row"])


def _split_lines(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"),
    )


def numbered_lines(raw: DataFrame) -> DataFrame:
    """`file, split, size, line, row` of a text reader, batch or stream: `row` numbers
    the lines of a file split from 0, so (file, split, row) is the order of the lines
    however the splits are dealt to tasks. Nothing is shuffled."""
    return _split_lines(raw).mapInArrow(_numbered, PLACED)


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of a folder of session files of any size.

    A big file is read by many tasks; the split is the chunk, and no file is ever a
    single row. A split has no more lines than bytes, and its first line begins after
    its first byte unless it is the first split; so split start + row (+ 1) ascends
    through the whole file.
    """
    raw = spark.read.options(**options).option("lineSep", "\n").text(path)
    return in_order(numbered_lines(raw), _split_lines(raw))


def in_order(numbered: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """The line table of `numbered_lines`. `split` may give the same lines without
    numbers, if these are cheaper to read again."""
    lines = numbered.select(
        F.col("file").alias("artifact_id"), F.col("split").alias("chunk"),
        (F.col("split") + F.col("row") + (F.col("split") > 0).cast("bigint")).alias("pos"), "line",
    )
    # The reader drops the empty line after a final line feed; put it back.
    last = (
        (numbered if split is None else split).groupBy("file", "size")
        .agg(
            F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("split").alias("chunk")
        )
        .where(F.col("bytes") == F.col("size"))
        .select(F.col("file").alias("artifact_id"), "chunk", F.lit(2**62).alias("pos"), F.lit("").alias("line"))
    )
    return lines.unionByName(last)


def write_lines(lines: DataFrame, root: str) -> DataFrame:
    """Write lines (`artifact_id`, a path below `root`, `pos`, `line`) as one file per
    artifact, and give `artifact_id, n_lines`. The inverse of `read_lines`.

    A file is written by one task in order of `pos`, a batch of lines at a time, from
    rows that Spark has sorted, so its size does not matter for memory. It gets its name
    when it is whole; a task that is run again replaces what it wrote.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        attempt, name, out, count = TaskContext.get().taskAttemptId(), None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{base}/{name}.{attempt}", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"artifact_id": [name], "n_lines": pa.array([count], pa.int64())})

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if names[lo] != name:
                    if out is not None:
                        yield close()
                    name, count = names[lo], 0
                    store.create_dir(f"{base}/{name}".rpartition("/")[0])
                    out = store.open_output_stream(f"{base}/{name}.{attempt}")
                elif count:
                    out.write(b"\n")
                out.write("\n".join(texts[lo:hi]).encode())
                count, lo = count + hi - lo, hi
        if out is not None:
            yield close()

    sorted_lines = lines.repartition("artifact_id").sortWithinPartitions("artifact_id", "pos")
    written = sorted_lines.select("artifact_id", "line").mapInArrow(run, "artifact_id string, n_lines bigint")
    return materialize(written, "written-files")


def lines_from_text(df: DataFrame, artifact: str = "artifact_id", text: str = "text") -> DataFrame:
    """Lines of a table with one whole text per row."""
    return df.select(
        F.col(artifact).alias("artifact_id"), F.posexplode(F.split(text, "\n", -1))
    ).select(
        "artifact_id",
        F.floor(F.col("pos") / LINES_PER_CHUNK).cast("bigint").alias("chunk"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("col").alias("line"),
    )


def chunk_bases(lines: DataFrame) -> DataFrame:
    """Per chunk: bytes before it in its artifact, own bytes, first/last flags."""
    w = Window.partitionBy("artifact_id").orderBy("chunk")
    return (
        lines.groupBy("artifact_id", "chunk")
        .agg(F.sum(F.octet_length("line") + 1).cast("bigint").alias("bytes"))
        .select(
            "*",
            F.coalesce(
                F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("base"),
            F.lead("chunk").over(w).isNull().alias("is_last"),
        )
    )


def digests(lines: DataFrame) -> DataFrame:
    """`artifact_id, n_lines, bytes, digest` of a line table.

    The digest is that of a tree: the hashes of DIGEST_FAN lines give the hash of a
    block, those of as many blocks the hash of a group, those of the groups the digest.
    It depends on the lines and their order alone, not on file splits or chunks, and no
    row holds more than the hashes below one node. Line hashes, not lines, are shuffled.
    """
    w = Window.partitionBy("artifact_id", "chunk").orderBy("pos")
    size = F.octet_length("line") + 1
    hashed = lines.select("artifact_id", "chunk", "pos", F.unhex(F.sha2("line", 256)).alias("hash"), size.alias("size"))
    of_chunk = lines.groupBy("artifact_id", "chunk").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    before = Window.partitionBy("artifact_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = of_chunk.select("artifact_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    leaves = hashed.withColumn("at", F.row_number().over(w) - 1).join(bases, ["artifact_id", "chunk"]).select(
        "artifact_id", (F.col("base") + F.col("at")).alias("node"), "hash")

    def above(nodes: DataFrame, node: Column) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))
        joined = F.array_join(F.transform(ordered, lambda x: F.lower(F.hex(x["hash"]))), "")
        return nodes.groupBy("artifact_id", node.alias("above")).agg(F.unhex(F.sha2(joined, 256)).alias("hash")).select(
            "artifact_id", F.col("above").alias("node"), "hash")

    upper = F.floor(F.col("node") / DIGEST_FAN).cast("bigint")
    root = above(above(above(leaves, upper), upper), F.lit(0).cast("bigint"))
    totals = of_chunk.groupBy("artifact_id").agg(
        F.sum("n").cast("bigint").alias("n_lines"), (F.sum("bytes") - 1).cast("bigint").alias("bytes"))
    return totals.join(root, "artifact_id").select(
        "artifact_id", "n_lines", "bytes", F.concat(F.lit("tree:"), F.lower(F.hex("hash"))).alias("digest"))
