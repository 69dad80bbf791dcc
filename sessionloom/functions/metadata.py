"""Log metadata: only known keys may be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.secrets import redact_value_sql


def _allowed() -> Column:
    return F.array(*[F.lit(k) for k in K.LOG_KEYS])


def allowed_metadata(record: Column) -> Column:
    """Entries of a map that have a known key and a value."""
    return F.map_filter(record, lambda k, v: F.array_contains(_allowed(), k) & v.isNotNull())


def rejected_keys(record: Column) -> Column:
    """Unknown keys of a map; a record with any of them is not written."""
    return F.array_except(F.map_keys(record), _allowed())


def loggable(records: DataFrame, record: str) -> DataFrame:
    """The rows with the map `record` reduced to known keys that have a value, and every
    secret in these values replaced."""
    kept = records.withColumn(record, allowed_metadata(F.col(record)))
    kind = kept.schema[record].dataType
    return kept.withColumn(record, F.expr(redact_value_sql(f"`{record}`", kind)))
