"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.session import materialize, work_dir

__all__ = ["fill_words", "map_batches", "materialize", "table", "texts_of", "work_dir"]

SLICE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and `text`, where a null text counts as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, schema: str, step: Callable[[dict[str, list]], Iterable[dict[str, list]]]) -> DataFrame:
    """Apply `step` to the columns (as Python lists) of each Arrow batch of each
    partition; it yields column dictionaries that fit `schema`."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for out in step(batch.to_pydict()):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE rows, none empty: what a task holds as
    Python objects stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def fill_words(lists: list[list], known: dict, limit: int, encode: Callable[[list], Iterable]) -> None:
    """Look up every word of `lists` that `known` lacks with `encode`. `known`
    lives as long as its Python worker and is emptied beyond `limit` entries, so
    its memory is bounded and its content has no effect on results."""
    words = set().union(*lists)
    if len(known) + len(words) > limit and not words <= known.keys():
        known.clear()
    if fresh := [w for w in words if w not in known]:
        known.update(zip(fresh, encode(fresh), strict=True))
