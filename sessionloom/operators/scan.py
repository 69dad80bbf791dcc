"""Row-level text scans over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions import secrets as X
from sessionloom.functions.text import let
from sessionloom.operators.prefix import bucket, prefix_sums


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer tasks than the cluster has slots (a few small
    files) before costly row work. A scan of usual size is left as it is, so no
    shuffle is added there. `df` must be a plain scan or projection of one.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


TOKEN_BLOCK = 64
_WALK = "struct<at:bigint,out:array<struct<offset:bigint,token:string>>>"


def _piece_size(x: Column) -> Column:
    return (F.char_length(x["gap"]) + F.coalesce(F.char_length(x["tok"]), F.lit(0))).cast("bigint")


def _starts(blocks: Column) -> Column:
    """Characters before each block of pieces."""
    def step(acc: Column, block: Column) -> Column:
        inside = F.aggregate(block, F.lit(0).cast("bigint"), lambda n, x: n + _piece_size(x))
        return F.struct((acc["at"] + inside).alias("at"),
                        F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(blocks, start, step, lambda acc: acc["out"])


def tokenize(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key, pos, offset, token`, offsets in characters.

    Nothing is shuffled: the pieces of a text are cut into blocks in its own row, the
    lengths of the blocks are summed there, and a walk over each block gives the offsets
    (a walk over the whole list would copy it once per piece).
    """
    def cut(p: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / F.lit(TOKEN_BLOCK)).cast("int")),
            lambda n: F.slice(p, n * TOKEN_BLOCK + 1, F.lit(TOKEN_BLOCK)))

    def placed(blocks: Column) -> Column:
        return F.zip_with(blocks, _starts(blocks), lambda b, at: F.struct(b.alias("block"), at.alias("at")))

    blocks = let(X.tokens(F.col(text)), lambda p: let(cut(p), placed))
    # The outer forms, as a plain one has its array computed once more for a filter.
    rows = df.select(key, F.posexplode_outer(blocks).alias("n", "b"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.struct((acc["at"] + F.char_length(x["gap"])).alias("offset"), x["tok"].alias("token"))
        return F.struct((acc["at"] + _piece_size(x)).alias("at"),
                        F.concat(acc["out"], F.array(hit)).alias("out"))

    start = F.struct(F.col("b.at").alias("at"), F.array().alias("out")).cast(_WALK)
    walk = F.aggregate("b.block", start, step, lambda acc: acc["out"])
    return rows.select(key, "n", F.posexplode_outer(walk).alias("i", "x")).where(F.col("x.token").isNotNull()).select(
        key, (F.col("n") * TOKEN_BLOCK + F.col("i")).cast("bigint").alias("pos"),
        F.col("x.offset").alias("offset"), F.col("x.token").alias("token"),
    )


def scan_secrets(
    df: DataFrame, key: list[str], text: str, threshold: float = K.ENTROPY_THRESHOLD
) -> DataFrame:
    """One row per hit: the key, `kind, offset, length, match`."""
    return (
        df.where(X.may_hold_secret(text))
        .select(*key, text, F.inline(X.secret_hits(text, threshold)))
        .select(
            *key, "kind", "offset", "length",
            F.substring(F.col(text), F.col("offset").cast("int") + 1, F.col("length").cast("int"))
            .alias("match"),
        )
    )


def split_chunks(df: DataFrame, key: str, order: str, text: str, size: int = 64) -> DataFrame:
    """Cut texts into pieces of `size` characters: `key, order, part, text`."""
    n = F.greatest(F.ceil(F.char_length(text) / F.lit(size)), F.lit(1)).cast("int")
    return df.select(
        key, order, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("part")
    ).select(
        key, order, F.col("part").cast("bigint").alias("part"),
        F.substring(F.col(text), F.col("part") * size + 1, F.lit(size)).alias("text"),
    )


CARRY_BLOCK = 256


def with_carry(chunks: DataFrame, key: str, seq: str, text: str, span: int) -> DataFrame:
    """Put the last `span` characters before each chunk in front of it (`window`).

    Empty chunks are left out and the others numbered, so `span` chunks always
    hold `span` characters. A chunk looks back inside its block of chunks and at
    the tail of the block before, an equi-join; no session is ever one group.
    """
    if not 0 < span < CARRY_BLOCK:
        raise ValueError("span must be below the block size")
    numbered = prefix_sums(
        chunks.where(F.char_length(text) > 0)
        .withColumn("__one", F.lit(1).cast("bigint"))
        .withColumn("__bucket", bucket(F.col(seq))),
        [key], ["__bucket"], [seq], {"__n": "__one"},
    ).withColumn("__block", bucket(F.col("__n"), CARRY_BLOCK))
    tail = F.right(F.col(text), F.lit(span))
    back = Window.partitionBy(key, "__block").orderBy("__n").rowsBetween(-span, -1)
    tails = (
        numbered.where(F.col("__n") % CARRY_BLOCK >= CARRY_BLOCK - span)
        .groupBy(key, (F.col("__block") + 1).alias("__block"))
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("__n", tail.alias("t")))), lambda x: x["t"]
                ),
                "",
            ).alias("__before")
        )
    )
    inside = numbered.withColumn("__inside", F.array_join(F.collect_list(tail).over(back), ""))
    carry = F.right(F.concat(F.coalesce("__before", F.lit("")), F.col("__inside")), F.lit(span))
    return inside.join(tails, [key, "__block"], "left").select(
        *chunks.columns, F.concat(carry, F.col(text)).alias("window")
    )


__all__ = ["scan_secrets", "split_chunks", "spread", "tokenize", "with_carry"]
