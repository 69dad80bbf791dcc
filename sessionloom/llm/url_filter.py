"""Operator 9: URL rules and, where no rule fits, logistic regression on hashed
character n-grams of host and path.

Everything is built from DataFrame functions; the model is Spark's own logistic
regression, fitted on a small labelled table (at most MAX_LABELLED rows) whose
weights, DIMS numbers, become a constant array in the scoring expression. So the
urls are scored in the scan, without a shuffle: no host can be a hot key.

Cases: a null url or one without "://" has an empty host and path, fits no rule
and has no n-grams, so it gets the verdict of the model's intercept; repeated rows
are judged each by itself; an empty table gives an empty result; of the other
columns only the key is read. If two rules of equal length fit, the one with the
longer host wins, then the one that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 2048
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Urls of unwanted and of ordinary pages, written for this table.
UNWANTED = (
    "http://www.cheap-pills.example.com/buy/1", "https://free-bets.example.net/join", "http://spam-farm.example.org/x/7",
    "https://m.ads-track.example.com/click?id=1", "http://casino-bonus.example.org/slots", "http://win-prize.example.net/claim",
    "https://ads.tracker.example.org/pixel", "http://cheap-watches.example.com/replica", "https://pills-online.example.net/order",
    "http://bets-live.example.com/odds", "http://adult-cams.example.net/live", "https://loan-fast.example.org/apply-now",
    "http://free-prize.example.org/claim.html", "https://track.ads-serve.example.net/c", "http://link-farm.example.com/page/4",
    "https://casino-free.example.net/spin", "http://cheap-loans.example.org/now", "https://spam-links.example.net/a/b",
    "http://www.poker-bets.example.org/join", "https://clickads.example.com/r?u=2", "http://download-free-crack.example.net/setup",
    "https://blog.spam-farm.example.com/en/12", "http://m.cheap-pills.example.net/fr/3", "http://www.free-bets.example.org/de/88.html",
    "https://ads-track.example.org/es/41", "http://blog.ads-track.example.net/en/5",
)
ORDINARY = (
    "https://news.example.com/2024/05/report.html", "https://www.library.example.org/catalogue/18", "http://museum.example.net/en/visit",
    "https://blog.garden.example.com/en/204", "https://docs.project.example.org/guide/install", "http://www.weather.example.net/fr/825",
    "https://m.theatre.example.org/de/612", "https://university.example.com/courses/history", "http://recipes.example.net/en/671",
    "https://www.council.example.org/en/334/", "http://science.example.com/en/articles/52", "https://travel.example.net/es/797#top",
    "http://music.example.org/en/453", "https://forum.example.com/thread/99?page=2", "https://wiki.example.net/page/Stone",
    "http://blog.harbour.example.com/fr/65.html", "https://sports.example.org/en/728", "https://www.thread.example.net/en/148.html",
    "https://weekly.thinking.example.com/en/25#top", "http://m.letters.example.org/de/131", "https://northern.example.net/en/369",
    "https://blog.station.example.com/es/533/", "http://thistle.example.org/fr/414", "https://www.another.example.net/en/471",
    "https://m.thorn.example.com/en/10?page=2&ref=x", "http://heron.example.org/en/976?utm_source=feed",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null."""
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    return F.coalesce(*[
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in order
    ], F.lit(None).cast("struct<rule:string,verdict:string>"))


def features(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams (1..DIMS) of the marked host and path."""
    def grams(text: Column, mark: str) -> list[Column]:
        marked = F.when(text != "", F.concat(F.lit("^"), text, F.lit("$"))).otherwise("")
        return [
            F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g))
            for n in GRAMS
        ]

    every = F.concat(*grams(host, "h"), *grams(path, "p"))
    return F.array_distinct(F.transform(every, lambda g: (F.pmod(F.xxhash64(g), F.lit(DIMS)) + 1).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1.0) for u in UNWANTED] + [(u, 0.0) for u in ORDINARY]
    both = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows]
    return spark.range(1).select(F.inline(F.array(*both)))


def fit(labelled: DataFrame, l2: float = 0.02, rounds: int = 40) -> tuple[list[float], float]:
    """Weights and intercept from (url, label 0 or 1); rows without a url or label are left out."""
    url = F.col("url")
    has = F.array_contains
    rows = (
        labelled.where(url.isNotNull() & F.col("label").isNotNull()).limit(MAX_LABELLED)
        .select("label", features(host_of(url), path_of(url)).alias("f"))
        .select("label", array_to_vector(F.transform(
            F.sequence(F.lit(1), F.lit(DIMS)), lambda i: F.when(has("f", i), 1.0).otherwise(0.0))).alias("features"))
    )
    model = LogisticRegression(maxIter=rounds, regParam=l2, standardization=False).fit(rows.coalesce(1))
    return [float(x) for x in model.coefficients], float(model.intercept)


def judged(pages: DataFrame, key: str, rules: tuple[Rule, ...], weights: list[float], intercept: float) -> DataFrame:
    """The key, host, path, fitting rule, score of the model and verdict of each url."""
    table = F.lit([float(x) for x in weights])
    parts = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    score = F.aggregate(features(F.col("host"), F.col("path")), F.lit(float(intercept)), lambda s, i: s + F.element_at(table, i))
    return (
        parts.select(key, "host", "path", fitting(F.col("host"), F.col("path"), rules).alias("__fits"), score.alias("score"))
        .select(
            key, "host", "path", F.col("__fits.rule").alias("rule"), "score",
            F.coalesce("__fits.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        )
    )
