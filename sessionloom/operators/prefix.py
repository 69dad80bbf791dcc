"""Running totals and ordered concatenation that never put one key in one task.

A plain `sum() OVER (PARTITION BY key ORDER BY pos)` sends a whole key to one
task, which fails when one key holds a third of all rows. Here the rows of a key
are cut into buckets: bucket totals (a map-side combined aggregate, small) are
summed over the key, and only the rows of one bucket meet in one window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K


def prefix_sums(
    df: DataFrame,
    key: list[str],
    levels: list[str],
    order: list[str],
    measures: dict[str, str],
) -> DataFrame:
    """Add exclusive running totals: `measures` maps an output column to the
    column it sums, in the order (levels..., order...) within each key.

    `levels` are bucket columns from coarse to fine, each non-decreasing in the
    wanted order; the finest bucket must hold a bounded number of rows. A null in a
    key, a level or the order is a value like others and sorts first. Without a
    key the totals are summed level by level, so that no window sees all buckets.
    """
    if not levels:
        w = _window(key, order)
        return df.select(
            "*", *[F.coalesce(F.sum(src).over(w), F.lit(0)).alias(out)
                   for out, src in measures.items()]
        )
    group = key + levels
    totals = df.groupBy(*group).agg(
        *[F.sum(src).alias(f"__t_{out}") for out, src in measures.items()]
    )
    of_totals = {f"__b_{o}": f"__t_{o}" for o in measures}
    if key:
        base = prefix_sums(totals, key, [], levels, of_totals)
    else:
        base = prefix_sums(totals, [], levels[:-1], [levels[-1]], of_totals)
    base = base.select(*group, *of_totals)
    w = _window(group, order)
    base = base.withColumnsRenamed({c: f"__g_{c}" for c in group})
    same = functools.reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__g_{c}")), group, F.lit(True))
    return df.join(base, same).select(
        *df.columns,
        *[(F.col(f"__b_{out}") + F.coalesce(F.sum(src).over(w), F.lit(0))).alias(out)
          for out, src in measures.items()],
    )


def _window(partition: list[str], order: list[str]):
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def bucket(pos: Column, size: int = K.PART_ITEMS) -> Column:
    return F.floor(pos / F.lit(size)).cast("bigint")


def _joined(order: list[str], text: str) -> Column:
    """Texts of a group in order, without a separator."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.array_join(F.transform(rows, lambda x: x["__text"]), "")


def concat_parts(
    pieces: DataFrame, key: list[str], levels: list[str], order: list[str], text: str = "text",
) -> DataFrame:
    """Join the ordered text pieces of each key: one row per key, of any length.

    The pieces of one bucket give a fragment, the fragments of a key its text, so
    a key's pieces are never sorted in one task. `part_no` is always 0.
    """
    group = key + levels
    fragments = pieces.groupBy(*group).agg(_joined(order, text).alias(text))
    return fragments.groupBy(*key).agg(_joined(levels, text).alias(text)).select(
        *key, F.lit(0).cast("bigint").alias("part_no"), text,
        F.char_length(text).cast("bigint").alias("chars"),
    )
