"""Operator 2: mixing sources to target weights by temperature.

Every source's share p of all tokens (words) becomes a weight in proportion to
p^a. The exponent a in [0, 1] is found by bisection, several halvings to a job: the
largest one whose weights reach a target entropy (as a part of the largest
possible one), or the smallest one that reads no source more often than a limit.

The weights are realised over a token budget. A source with budget b and T tokens
is read b/T times: whole passes, then a last pass as far as the budget reaches.
Every pass goes through the source in another pseudo-random order (MD5 of seed,
pass and document). A document's place in its source's stream, as a part of the
source's budget, chooses its block, so every block of about `block_tokens` tokens
holds all sources in the target proportions; inside a block the order is a
pseudo-random permutation over all sources. Running totals are taken in buckets, so
a source that holds a third of all rows is spread over tasks.

Without a budget the smallest one is taken that reads every document at least once.

Cases: a null source counts as the source ""; a null or blank text has no words and
counts as one token, so that every row has a place; rows with equal doc_id, source
and number of words stand together, with their number as a factor; one source alone
has weight 1; an empty table gives an empty schedule. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import materialize
from sessionloom.operators.prefix import prefix_sums

WORD_ENDS = r"[^\x20\x09-\x0D]++"
POINTS, ROUNDS, DIGITS = 32, 5, 4
UNIT = ["source", "doc_id", "n_tokens"]


def words(text: Column) -> Column:
    """Number of words: what is left if each word becomes one sign and spaces go."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_ENDS, "w")
    return F.char_length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """source, doc_id, n_tokens and the number of rows that share them."""
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(words(F.col("text")), F.lit(1)).alias("n_tokens"),
    )
    return rows.groupBy(*UNIT).agg(F.count("*").alias("rows"))


def source_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"))


def _figures(shares: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of p^a, that of p^a ln p, and the number of sources."""
    p = F.col("tokens") / F.lit(float(total))
    powers = [F.pow(p, F.lit(a)) for a in exponents]
    row = shares.agg(
        F.count("*"), *[F.sum(x) for x in powers], *[F.sum(x * F.log(p)) for x in powers],
    ).first()
    n = len(exponents)
    return [(row[1 + i], row[1 + n + i], row[0]) for i in range(n)]


def exponent(shares: DataFrame, budget: int | None, entropy: float | None, repeats: float | None) -> tuple[float, int]:
    """The exponent, cut to DIGITS digits towards the target, and the token budget."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give either a target entropy or a limit of repeats")
    top = shares.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if top[0] is None:
        return 1.0, 0
    total, least, most = (int(x) for x in top)

    def asked(a: float, z: float, l: float, n: int) -> bool:  # noqa: E741
        """True on the side of the small exponents."""
        if entropy is not None:
            return math.log(z) - a * l / z >= entropy * math.log(n) - 1e-12
        tokens = budget if budget is not None else total * z * (most / total) ** (1 - a)
        return tokens / total * (least / total) ** (a - 1) / z > repeats

    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
        small = [asked(a, *f) for a, f in zip(points, _figures(shares, points, total), strict=True)]
        if all(small) or not any(small):
            lo = hi = 1.0 if all(small) else 0.0
            break
        k = small.index(False)
        lo, hi = points[k - 1] if k else points[0], points[k]
    scale = 10 ** DIGITS
    a = math.floor(lo * scale) / scale if entropy is not None else min(1.0, math.ceil(hi * scale) / scale)
    z = _figures(shares, [a], total)[0][0]
    return a, budget if budget is not None else math.ceil(total * z * (most / total) ** (1 - a))


def source_budgets(shares: DataFrame, a: float, budget: int, whole: bool = False) -> DataFrame:
    """source, tokens, weight and its part of the budget; with `whole` at least its
    own tokens, so that rounding a weight down leaves no unit out."""
    total = shares.agg(F.sum("tokens").alias("total"))
    power = shares.crossJoin(total).select("source", "tokens", F.pow(F.col("tokens") / F.col("total"), F.lit(a)).alias("power"))
    both = power.crossJoin(power.agg(F.sum("power").alias("z")))  # one row each
    weight = F.round(F.col("power") / F.col("z"), 9)
    part = F.floor(weight * F.lit(float(budget)))
    return both.select("source", "tokens", weight.alias("weight"), F.greatest(part, F.col("tokens") if whole else F.lit(1)).alias("budget"))


def schedule(
    docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float | None = None,
    block_tokens: int = 1 << 20, seed: int = 1,
) -> DataFrame:
    """One row per unit and pass that is read: source, doc_id, n_tokens, rows, pass
    (from 0), block, place (from 1, inside the block)."""
    rows = materialize(units(docs), "mix-units")
    shares = materialize(source_tokens(rows), "mix-shares")
    a, tokens = exponent(shares, budget, entropy, repeats)
    parts = source_budgets(shares, a, tokens, whole=budget is None)
    passes = rows.join(parts, "source").withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("tokens"))))
    )
    order = F.md5(F.concat_ws("|", F.lit(seed), "pass", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "n_tokens"))
    passes = passes.withColumns({"key": order, "bucket": F.substring(order, 1, 3), "weighed": F.col("n_tokens") * F.col("rows")})
    placed = prefix_sums(passes, ["source", "pass"], ["bucket"], ["key", "doc_id", "n_tokens"], {"before": "weighed"})
    at = F.col("pass") * F.col("tokens") + F.col("before")
    blocks = max(1, math.ceil(tokens / block_tokens))
    # Whole-number arithmetic, so that a place never falls on the wrong side of a border.
    block = F.floor((at.cast("decimal(38,0)") * blocks) / F.col("budget").cast("decimal(20,0)")).cast("long")
    inside = F.md5(F.concat_ws("|", F.lit(seed), F.lit("b"), "key", "source"))
    read = placed.where(at < F.col("budget")).select(*UNIT, "rows", "pass", block.alias("block"), inside.alias("inside"))
    w = Window.partitionBy("block").orderBy("inside", "source", "doc_id", "n_tokens")
    return read.select(*UNIT, "rows", "pass", "block", F.row_number().over(w).cast("long").alias("place"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` as the schedule reads them: repeated or left out, in the
    order of blocks and places, with the columns of `docs`."""
    plan = schedule(docs, **how).select(*[F.col(c).alias(f"__{c}") for c in UNIT], F.col("block").alias("__block"), F.col("place").alias("__place"))
    same = (
        (F.coalesce(docs["source"], F.lit("")) == F.col("__source")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__doc_id"))
        & (F.greatest(words(docs["text"]), F.lit(1)) == F.col("__n_tokens"))
    )
    out = docs.join(plan, same).sort("__block", "__place")
    return out.select(*[docs[c] for c in docs.columns])
