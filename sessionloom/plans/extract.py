"""Batch extraction with a model: prompts, cache, completion, parsing, merge.

Equal prompts are answered once, cached answers are reused, and the model is a
function from a pandas frame to a pandas frame that Spark calls per batch. Every
round of answers is written down before it is used, so no answer is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.text import first_json_object, full_trim, interpolate, let
from sessionloom.operators.prefix import bucket, concat_parts, prefix_sums
from sessionloom.plans.compile import tail_excerpt
from sessionloom.session import materialize
from sessionloom.sources.packets import json_type

# Turns of a session that are joined at once.
TURNS_PER_FRAGMENT = 256

# Prompt texts (system, user) by extractor.
PROMPTS: dict[str, tuple[str, str]] = {
    "objective": (
        "Name the goal of this session in one sentence. Answer with one JSON object: "
        '{"objective": string, "confidence": number from 0 to 1}.',
        "Excerpt:\n{{transcript_excerpt}}\n\nTicket:\n{{ticket_text}}\n",
    ),
    "attempts": (
        "List what was tried in this session. Answer with one JSON object: "
        '{"attempts": [{"summary": string, "result": string, "failure_reason": string or null, '
        '"evidence_span": string}]}.',
        "Excerpt:\n{{transcript_excerpt}}\n",
    ),
    "acceptance-criteria": (
        "State when this work is done. Answer with one JSON object: "
        '{"criteria": [{"text": string, "required": boolean}]}.',
        "Objective:\n{{objective}}\n\nTicket:\n{{ticket_text}}\n\nExcerpt:\n{{transcript_excerpt}}\n",
    ),
    "next-action": (
        "Name the one next step. Answer with one JSON object: "
        '{"next_action": string, "confidence": number from 0 to 1}.',
        "Summary:\n{{packet_summary}}\n",
    ),
}
PROMPT = ["packet_id", "extractor", "part_no", "system", "user"]


def _prompt(df: DataFrame, extractor: str, values: dict[str, Column],
            part_no: Column | None = None) -> DataFrame:
    system, user = PROMPTS[extractor]
    return df.select(
        "packet_id", F.lit(extractor).alias("extractor"),
        (part_no if part_no is not None else F.lit(0)).cast("bigint").alias("part_no"),
        F.lit(system).alias("system"), interpolate(user, values).alias("user"),
    )


def objective_prompts(sessions: DataFrame, tails: DataFrame) -> DataFrame:
    df = sessions.join(tails, "session_id", "left")
    return _prompt(df, "objective", {"transcript_excerpt": F.col("excerpt"),
                                     "ticket_text": F.lit("")})


def attempt_prompts(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """One question about the whole session, whatever its length."""
    pieces = turns.select(
        "session_id", bucket(F.col("ord"), TURNS_PER_FRAGMENT).alias("bucket"), "ord",
        F.concat(F.lit("\n\n"), F.upper("role"), F.lit(": "), F.col("text")).alias("text"),
    )
    parts = concat_parts(pieces, ["session_id"], ["bucket"], ["ord"])
    return _prompt(
        sessions.join(parts, "session_id", "left"), "attempts",
        {"transcript_excerpt": F.expr("substring(text, 3)")},
        F.coalesce("part_no", F.lit(0)),
    )


def criteria_prompts(sessions: DataFrame, tails: DataFrame, objectives: DataFrame) -> DataFrame:
    df = sessions.join(tails, "session_id", "left").join(objectives, "packet_id", "left")
    return _prompt(df, "acceptance-criteria", {
        "objective": F.col("objective"), "ticket_text": F.lit(""),
        "transcript_excerpt": F.col("excerpt"),
    })


def recent_attempts(attempts: DataFrame, n: int = K.RECENT_ATTEMPTS) -> DataFrame:
    """`packet_id, recent`: the last summaries as a numbered list."""
    w = Window.partitionBy("packet_id").orderBy(F.col("pos").desc())
    last = attempts.select("packet_id", "pos", "summary").withColumn(
        "rank", F.row_number().over(w)
    ).where(F.col("rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("pos", "summary")))
    return last.groupBy("packet_id").agg(
        F.array_join(
            F.transform(rows, lambda x, i: F.concat(
                F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["summary"])),
            "\n",
        ).alias("recent")
    )


def next_prompts(drafts: DataFrame, recent: DataFrame) -> DataFrame:
    """`drafts`: packet_id, objective, current_state."""
    summary = F.concat(
        F.lit("Objective: "), F.col("objective"), F.lit("\n\nCurrent state: "),
        F.col("current_state"), F.lit("\n\nRecent attempts:\n"),
        F.coalesce("recent", F.lit("(none)")),
    )
    return _prompt(drafts.join(recent, "packet_id", "left"), "next-action",
                   {"packet_summary": summary})


def prompt_key(provider: str) -> Column:
    """Digest of the request in canonical JSON (keys in order); the model is left
    out, so that answers of any model are reused."""
    body = F.to_json(F.struct(
        F.lit("__extractor__").alias("model"), F.lit(provider).alias("provider"),
        F.col("system").alias("systemPrompt"), F.lit(0).alias("temperature"),
        F.col("user").alias("userPrompt"),
    ))
    return F.sha2(body, 256)


# ---- Parsing ---------------------------------------------------------------

def _string(v: Column, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(json_type(inner) == "string", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(json_type(inner) == "array", F.try_variant_get(v, path, "array<variant>"))


def _filled(c: Column) -> Column:
    t = full_trim(c)
    return F.when(t != "", t)


def clamp_confidence(v: Column) -> Column:
    raw = F.try_variant_get(v, "$.confidence", "variant")
    n = F.when(json_type(raw) == "number", F.try_variant_get(v, "$.confidence", "double"))
    return F.when(n < 0, 0.0).when(n > 1, 1.0).otherwise(F.coalesce(n, F.lit(0.5)))


def _attempt(a: Column) -> Column:
    return F.struct(
        _filled(_string(a, "$.summary")).alias("summary"),
        let(_string(a, "$.result"), lambda r: F.when(r.isin(K.ATTEMPT_RESULTS), r)
            .otherwise("unknown")).alias("result"),
        _filled(_string(a, "$.failure_reason")).alias("failure_reason"),
        F.left(F.coalesce(_string(a, "$.evidence_span"), F.lit("")), F.lit(K.EVIDENCE_CAP))
        .alias("evidence_span"),
    )


def _criterion(c: Column) -> Column:
    is_boolean = json_type(F.try_variant_get(c, "$.required", "variant")) == "boolean"
    return F.struct(
        _filled(_string(c, "$.text")).alias("text"),
        F.coalesce(is_boolean & F.try_variant_get(c, "$.required", "boolean"), F.lit(False))
        .alias("required"),
    )


def parse_responses(df: DataFrame, raw: str = "text") -> DataFrame:
    """Adds `ok`, `value` (objective or next action), `confidence`, `attempts`
    and `criteria` to rows with `extractor` and a raw answer. The answer is
    parsed once; all fields come out of one bound value."""
    def fields(v: Column) -> Column:
        text = F.when(F.col("extractor") == "objective", _filled(_string(v, "$.objective"))).when(
            F.col("extractor") == "next-action", _filled(_string(v, "$.next_action")))
        attempts = F.when(F.col("extractor") == "attempts", F.filter(
            F.transform(_list(v, "$.attempts"), _attempt), lambda a: a["summary"].isNotNull()))
        criteria = F.when(F.col("extractor") == "acceptance-criteria", F.filter(
            F.transform(_list(v, "$.criteria"), _criterion), lambda c: c["text"].isNotNull()))
        return F.struct(
            text.alias("value"), clamp_confidence(v).alias("confidence"),
            attempts.alias("attempts"), criteria.alias("criteria"),
        )

    p = let(F.try_parse_json(first_json_object(F.col(raw))), fields)
    return df.withColumn("p", p).select(
        *df.columns, F.col("p.value").alias("value"),
        F.when(F.col("p.value").isNotNull(), F.col("p.confidence")).alias("confidence"),
        F.col("p.attempts").alias("attempts"), F.col("p.criteria").alias("criteria"),
        F.coalesce(F.col("p.value").isNotNull() | F.col("p.attempts").isNotNull()
                   | F.col("p.criteria").isNotNull(), F.lit(False)).alias("ok"),
    )


# ---- Cache and completion --------------------------------------------------

# A model: a frame of key, extractor, system, user and attempt to a frame of ANSWER.
CompleteFn = Callable[[pd.DataFrame], pd.DataFrame]
ANSWER = "key string, extractor string, text string, tokens_in bigint, tokens_out bigint, model string"


def _ask(requests: DataFrame, complete: CompleteFn, attempt: int, parallelism: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield complete(batch)

    rows = requests.select("key", "extractor", "system", "user", F.lit(attempt).alias("attempt"))
    return materialize(
        rows.repartition(parallelism, "key").mapInPandas(run, ANSWER), f"answers-{attempt}"
    )


def cache_hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys whose cached answer can still be read; `cache`: key, text, model."""
    wanted = keyed.groupBy("key").agg(F.min("extractor").alias("extractor"))
    return parse_responses(wanted.join(cache.select("key", "text", "model"), "key")).where("ok")


def complete_prompts(
    prompts: DataFrame,
    complete: CompleteFn,
    provider: str,
    cache: DataFrame | None = None,
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, cache additions).

    Answers: one row per prompt row with the parsed fields, `ok`, tokens and
    `live`. A live answer that cannot be read is asked once more; the tokens of
    both attempts count, and only readable answers enter the cache. Requests and
    parsed answers are written down, so later steps start from small plans.
    """
    spark = prompts.sparkSession
    n = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialize(prompts.withColumn("key", prompt_key(provider)), "prompts")
    distinct = keyed.select("key", "extractor", "system", "user").dropDuplicates(["key"])
    hits = None
    if cache is not None:
        hits = cache_hits(keyed, cache).select(
            "key", "extractor", "text", F.lit(0).cast("bigint").alias("tokens_in"),
            F.lit(0).cast("bigint").alias("tokens_out"), "model",
        )
        distinct = distinct.join(hits.select("key"), "key", "left_anti")
    first = _ask(distinct, complete, 1, n)
    failed = parse_responses(first).where("NOT ok").select(
        "key", F.col("tokens_in").alias("in1"), F.col("tokens_out").alias("out1")
    )
    second = _ask(distinct.join(failed, "key", "left_semi"), complete, 2, n)
    again = second.join(failed, "key").select(
        "key", "extractor", "text", (F.col("tokens_in") + F.col("in1")).alias("tokens_in"),
        (F.col("tokens_out") + F.col("out1")).alias("tokens_out"), "model",
    )
    live = first.join(second.select("key"), "key", "left_anti").unionByName(again).withColumn(
        "live", F.lit(True)
    )
    if hits is not None:
        live = live.unionByName(hits.withColumn("live", F.lit(False)))
    answers = materialize(parse_responses(live), "parsed")
    fresh = answers.where("live AND ok").select("key", "text", "model", "tokens_in", "tokens_out")
    found = keyed.select("packet_id", "extractor", "part_no", "key").join(
        answers.drop("extractor"), "key"
    )
    return found, fresh


def stamped_attempts(found: DataFrame, now: str) -> DataFrame:
    """Attempt rows with ids `attempt-1`, `attempt-2`... over all parts."""
    sized = found.where("attempts IS NOT NULL").select(
        "packet_id", "part_no", "attempts", F.size("attempts").cast("bigint").alias("n")
    )
    placed = prefix_sums(sized, ["packet_id"], [], ["part_no"], {"before": "n"})
    return placed.select("packet_id", "before", F.posexplode("attempts").alias("i", "a")).select(
        "packet_id", (F.col("before") + F.col("i")).alias("pos"),
        F.concat(F.lit("attempt-"), (F.col("before") + F.col("i") + 1).cast("string")).alias("id"),
        F.lit("unknown").alias("tool"), "a.summary", "a.result", "a.failure_reason",
        F.lit(0).cast("bigint").alias("n_refs"), F.lit(now).alias("created_at"),
    )


def stamped_criteria(found: DataFrame) -> DataFrame:
    return found.where("criteria IS NOT NULL").select(
        "packet_id", F.posexplode("criteria").alias("i", "c")
    ).select(
        "packet_id", F.col("i").cast("bigint").alias("pos"),
        F.concat(F.lit("ac-"), (F.col("i") + 1).cast("string")).alias("id"), "c.text",
        F.lit("unknown").alias("status"), "c.required", F.lit("derived").alias("source"),
        F.lit(0).cast("bigint").alias("n_refs"),
    )


def parse_warnings(found: DataFrame) -> DataFrame:
    return found.where("NOT ok").select(
        "packet_id", F.lit("COMPILE_LLM_PARSE_FAILED").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat("extractor", F.lit(": LLM response did not parse as valid JSON after one retry."))
        .alias("message"),
    )


def compile_full(
    turns: DataFrame, drafts: DataFrame, complete: CompleteFn | None, provider: str,
    cache: DataFrame | None = None,
    now: str = "1970-01-01T00:00:00.000Z",
) -> dict[str, DataFrame]:
    """Drafts with the extracted fields: `packets`, `attempts`, `criteria`,
    `warnings`, `usage` and `cache` (new entries).

    Three rounds, since later prompts need earlier answers: objective and
    attempts, then criteria, then next action. Without a model the drafts stay
    as they are and every packet gets a warning.
    """
    if complete is None:
        warned = drafts.select(
            "packet_id", F.lit("COMPILE_LLM_NOT_CONFIGURED").alias("code"),
            F.lit("warning").alias("severity"),
            F.lit("A full compile was asked for but no model is configured. Falling back to the "
                  "fast narrative.").alias("message"),
        )
        return {"packets": drafts, "warnings": warned}
    sessions = drafts.select("packet_id", "session_id")
    tails = tail_excerpt(turns)

    def round_of(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
        return complete_prompts(prompts, complete, provider, cache)

    found1, fresh1 = round_of(
        objective_prompts(sessions, tails).unionByName(attempt_prompts(sessions, turns))
    )
    objective = found1.where("extractor = 'objective' AND ok").select(
        "packet_id", F.col("value").alias("x_objective"), F.col("confidence").alias("x_confidence")
    )
    attempts = stamped_attempts(found1.where("extractor = 'attempts'"), now)
    merged = drafts.join(objective, "packet_id", "left").withColumn(
        "objective", F.coalesce("x_objective", "objective")
    ).withColumn("confidence_score", F.coalesce("x_confidence", "confidence_score")).drop(
        "x_objective", "x_confidence"
    )
    found2, fresh2 = round_of(
        criteria_prompts(sessions, tails, merged.select("packet_id", "objective"))
    )
    found3, fresh3 = round_of(next_prompts(
        merged.select("packet_id", "objective", "current_state"), recent_attempts(attempts)
    ))
    action = found3.where("ok").select("packet_id", F.col("value").alias("x_next"))
    packets = merged.join(action, "packet_id", "left").withColumn(
        "next_action", F.coalesce("x_next", "next_action")
    ).drop("x_next")
    cols = ["packet_id", "extractor", "part_no", "ok", "live", "tokens_in", "tokens_out", "model"]
    usage = [f.select(*cols) for f in (found1, found2, found3)]
    warnings = [parse_warnings(f) for f in (found1, found2, found3)]
    return {
        "packets": packets, "attempts": attempts, "criteria": stamped_criteria(found2),
        "usage": reduce(DataFrame.unionByName, usage),
        "warnings": reduce(DataFrame.unionByName, warnings),
        "cache": reduce(DataFrame.unionByName, [fresh1, fresh2, fresh3]),
    }


# ---- Usage, cost, eviction -------------------------------------------------

def extraction_usage(calls: DataFrame, key: list[str]) -> DataFrame:
    return calls.groupBy(*key).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.count_if("live").alias("calls_live"), F.count_if(~F.col("live")).alias("calls_cached"),
    )


def estimate_cost(usage: DataFrame) -> DataFrame:
    """Adds `cost_min` and `cost_max` in USD; NULL where there is no price. The
    price list is a constant of a few rows, written into the expression."""
    def rate(i: int) -> Column:
        out = F.lit(None).cast("double")
        for p in K.PRICES:
            hit = (F.col("provider") == p[0]) & (F.col("model") == p[1])
            out = F.when(hit, F.lit(p[i])).otherwise(out)
        return out

    point = F.col("tokens_in") / 1000 * rate(2) + F.col("tokens_out") / 1000 * rate(3)
    return usage.withColumn("cost_min", point * K.COST_SPREAD[0]).withColumn(
        "cost_max", point * K.COST_SPREAD[1]
    )


def evict(entries: DataFrame, budget: int = K.CACHE_BUDGET_BYTES) -> DataFrame:
    """Entries that stay: the most recently used ones within `budget` bytes.

    `entries`: key, size, last_accessed (ISO text; NULL counts as never used).
    Within one instant the smaller key counts as the newer one; sizes are not negative.

    The border is found level by level: by day, by second of the border day, by instant,
    by key prefix. Each level is a map-side combined sum of the rows inside the border so
    far, of which one row is read. Newer rows stay by a filter alone; only the rows of
    the last border, of one instant and key prefix, are ranked.
    """
    used = F.unix_micros(F.try_to_timestamp("last_accessed"))
    at = F.coalesce(used, F.lit(-(2**60)))
    name = F.coalesce("key", F.lit(""))
    levels = {
        "__day": -F.floor(at / 86_400_000_000), "__second": -F.floor(at / 1_000_000),
        "__instant": -at, "__k1": F.left(name, F.lit(2)), "__k2": F.left(name, F.lit(4)),
    }
    rows = entries.select("*", *[e.alias(n) for n, e in levels.items()])
    inside, newer, same, spent = rows, F.lit(False), F.lit(True), 0
    for level in levels:
        sums = inside.groupBy(level).agg(F.sum("size").alias("__n"))
        upto = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        border = sums.select(level, "__n", F.sum("__n").over(upto).alias("__total")).where(
            F.col("__total") + spent > budget).agg(F.min(F.struct(level, "__n", "__total"))).first()[0]
        if border is None:  # all that is left fits
            return rows.where((newer | same) & F.col("size").isNotNull()).select(*entries.columns)
        newer = newer | (same & (F.col(level) < F.lit(border[level])))
        same = same & (F.col(level) == F.lit(border[level]))
        spent += border["__total"] - border["__n"]
        inside = rows.where(same)
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("__total", F.sum("size").over(upto)).where(F.col("__total") + spent <= budget)
    kept = rows.where(newer).select(*entries.columns).unionByName(last.select(*entries.columns))
    return kept.where(F.col("size").isNotNull())
