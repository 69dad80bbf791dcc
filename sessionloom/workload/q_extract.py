"""Queries over model extraction, its cache and its cost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.operators.scan import spread
from sessionloom.plans import compile as C
from sessionloom.plans import extract as X
from sessionloom.workload.derived import check_sql, table
from sessionloom.workload.q_compile import CX, NOW, compiled, turns
from sessionloom.workload.registry import query


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(extractor: str, values: dict[str, str]) -> str:
    """The user prompt as a concatenation."""
    text = X.PROMPTS[extractor][1]
    out = _sql(text)
    for name, expr in values.items():
        out = out.replace("{{" + name + "}}", f"' || {expr} || '")
    return out.replace("\n", "' || chr(10) || '")


TAIL = """SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY ord) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord DESC) AS rn FROM turns) t WHERE rn <= 12 GROUP BY conv_id"""
WHOLE = "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY ord) AS excerpt FROM turns GROUP BY conv_id"
RECENT = """SELECT packet_id, string_agg('  ' || i || '. ' || summary, chr(10) ORDER BY i) AS recent FROM (
  SELECT packet_id, summary, row_number() OVER (PARTITION BY packet_id ORDER BY pos) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY pos DESC) AS rn FROM attempts) a WHERE rn <= 5) b GROUP BY packet_id"""


def _row(extractor, values, src):
    return (f"SELECT packet_id, '{extractor}' AS extractor, CAST(0 AS BIGINT) AS part_no, {_sql(X.PROMPTS[extractor][0])} AS system, "
            f"{fill(extractor, values)} AS \"user\" FROM {src}")


PROMPTS = " UNION ALL ".join([
    _row("objective", {"transcript_excerpt": "excerpt", "ticket_text": "''"}, "compiled JOIN tails ON conv_id = session_id"),
    _row("attempts", {"transcript_excerpt": "excerpt"}, "compiled JOIN wholes ON conv_id = session_id"),
    _row("acceptance-criteria", {"objective": "objective", "ticket_text": "''", "transcript_excerpt": "excerpt"}, "compiled JOIN tails ON conv_id = session_id"),
    _row("next-action", {"packet_summary": "'Objective: ' || objective || chr(10) || chr(10) || 'Current state: ' || current_state || chr(10) || chr(10) || 'Recent attempts:' || chr(10) || coalesce(recent, '(none)')"},
         "compiled LEFT JOIN recents USING (packet_id)"),
])


@query("build_prompts", check_sql(PROMPTS, {**CX, "tails": TAIL, "wholes": WHOLE, "recents": RECENT}))
def build_prompts(spark, sf):
    return _prompts(spark, sf)


def _prompts(spark, sf):
    drafts, t = compiled(spark, sf), turns(spark, sf)
    sessions, tails = drafts.select("packet_id", "session_id"), C.tail_excerpt(t)
    return (
        X.objective_prompts(sessions, tails)
        .unionByName(X.attempt_prompts(sessions, t))
        .unionByName(X.criteria_prompts(sessions, tails, drafts.select("packet_id", "objective")))
        .unionByName(X.next_prompts(drafts, X.recent_attempts(table(spark, sf, "attempts"))))
    )


@query("prompt_keys", check_sql("""
SELECT min(extractor) AS extractor, count(*) AS uses, md5(system || '|' || "user") AS prompt FROM prompts GROUP BY system, "user\"""",
    {**CX, "tails": TAIL, "wholes": WHOLE, "recents": RECENT, "prompts": PROMPTS}))
def prompt_keys(spark, sf):
    keyed = _prompts(spark, sf).withColumn("key", X.prompt_key("rule"))
    return keyed.groupBy("key").agg(
        F.min("extractor").alias("extractor"), F.count("*").alias("uses"),
        F.min(F.md5(F.concat_ws("|", "system", "user"))).alias("prompt")).drop("key")


@query("recent_attempts", check_sql("SELECT * FROM recents", {"recents": RECENT}))
def recent_attempts(spark, sf):
    return X.recent_attempts(table(spark, sf, "attempts"))


TXT = "CASE WHEN extractor IN ('objective', 'next-action') AND event_id % 7 NOT IN (2, 3, 4) THEN 'Do ' || event_id END"


@query("parse_responses", check_sql(f"""
SELECT event_id, extractor, CASE WHEN extractor IN ('attempts', 'acceptance-criteria') THEN event_id % 5 <> 0
    ELSE event_id % 7 NOT IN (2, 3, 4) END AS ok, {TXT} AS value,
  CASE WHEN ({TXT}) IS NULL THEN NULL WHEN event_id % 7 = 0 THEN 1.0::DOUBLE WHEN event_id % 7 = 1 THEN 0.5::DOUBLE
    ELSE (event_id % 10) / 10.0::DOUBLE END AS confidence,
  CASE WHEN extractor = 'attempts' AND event_id % 5 <> 0 THEN 's' || event_id || '/failed/r/240; t/unknown/-/0' END AS attempts,
  CASE WHEN extractor = 'acceptance-criteria' AND event_id % 5 <> 0 THEN 'c' || event_id || '/true; u/false' END AS criteria
FROM responses"""))
def parse_responses(spark, sf):
    got = X.parse_responses(spread(table(spark, sf, "responses")), "raw")
    return got.select(
        "event_id", "extractor", "ok", "value", "confidence",
        F.when(F.col("attempts").isNotNull(), F.array_join(F.transform("attempts", lambda a: F.concat_ws(
            "/", a["summary"], a["result"], F.coalesce(a["failure_reason"], F.lit("-")),
            F.char_length(a["evidence_span"]).cast("string"))), "; ")).alias("attempts"),
        F.when(F.col("criteria").isNotNull(), F.array_join(F.transform("criteria", lambda a: F.concat_ws(
            "/", a["text"], a["required"].cast("string"))), "; ")).alias("criteria"),
    )


@query("cache_hits", check_sql("""
SELECT conv_id, c.payload IS NOT NULL AND json_valid(c.payload) AS hit,
  CASE WHEN json_valid(c.payload) THEN 'Finish ' || conv_id END AS value
FROM convs LEFT JOIN cache_entries c ON c.key = md5('prompt-' || conv_id)"""))
def cache_hits(spark, sf):
    keyed = table(spark, sf, "convs").select(
        "conv_id", F.md5(F.concat(F.lit("prompt-"), F.col("conv_id").cast("string"))).alias("key"),
        F.lit("objective").alias("extractor"),
    )
    cache = table(spark, sf, "cache_entries").select(
        "key", F.col("payload").alias("text"), F.lit("mock-1").alias("model")
    )
    hits = X.cache_hits(keyed, cache).select("key", "value")
    return keyed.join(hits, "key", "left").select(
        "conv_id", F.col("value").isNotNull().alias("hit"), "value"
    )


BUDGET = 60_000


@query("cache_evict", check_sql(f"""
SELECT key, CAST(size AS BIGINT) AS size, last_accessed FROM (
  SELECT *, sum(size) OVER (ORDER BY last_accessed DESC NULLS LAST, key ROWS UNBOUNDED PRECEDING) AS total FROM cache_entries) c WHERE total <= {BUDGET}"""))
def cache_evict(spark, sf):
    return X.evict(table(spark, sf, "cache_entries"), BUDGET).select(
        "key", F.col("size").cast("bigint"), "last_accessed"
    )


USAGE = """SELECT packet_id, provider, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  count(*) FILTER (WHERE live) AS calls_live, count(*) FILTER (WHERE NOT live) AS calls_cached
FROM model_calls GROUP BY packet_id, provider, model"""


@query("extraction_usage", check_sql(USAGE))
def extraction_usage(spark, sf):
    return X.extraction_usage(table(spark, sf, "model_calls"), ["packet_id", "provider", "model"])


@query("estimate_cost", check_sql(f"""
SELECT u.packet_id, u.provider, u.model, round((tokens_in / 1000::DOUBLE * pin + tokens_out / 1000::DOUBLE * pout) * 0.75::DOUBLE, 12) AS cost_min,
  round((tokens_in / 1000::DOUBLE * pin + tokens_out / 1000::DOUBLE * pout) * 1.25::DOUBLE, 12) AS cost_max
FROM ({USAGE}) u LEFT JOIN (VALUES ('anthropic', 'claude-sonnet-4-5', 0.003::DOUBLE, 0.015::DOUBLE), ('openai', 'gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE))
  p(provider, model, pin, pout) ON p.provider = u.provider AND p.model = u.model"""))
def estimate_cost(spark, sf):
    usage = X.extraction_usage(table(spark, sf, "model_calls"), ["packet_id", "provider", "model"])
    return X.estimate_cost(usage).select(
        "packet_id", "provider", "model", F.round("cost_min", 12).alias("cost_min"),
        F.round("cost_max", 12).alias("cost_max"),
    )


def answer_by_length(batch: pd.DataFrame) -> pd.DataFrame:
    """A model of text rules, which SQL can repeat: the answer tells the length of
    the prompt. Lengths that end in 0 give no answer, in 1 none at the first attempt."""
    n = batch["user"].str.len()
    texts = [
        "no answer" if k % 10 == 0 or k % 10 == 1 and attempt == 1 else ANSWERS[extractor].replace("#", str(k))
        for k, extractor, attempt in zip(n, batch["extractor"], batch["attempt"], strict=True)
    ]
    return pd.DataFrame({
        "key": batch["key"], "extractor": batch["extractor"], "text": texts,
        "tokens_in": -(-(batch["system"].str.len() + n) // 4), "tokens_out": [-(-len(t) // 4) for t in texts],
        "model": "rule-1",
    })


ANSWERS = {
    "objective": '{"objective": "Finish #", "confidence": 0.75}',
    "attempts": '{"attempts": [{"summary": "Tried #", "result": "failed", "failure_reason": "broke", "evidence_span": "#"}, '
                '{"summary": "Tried # again", "result": "succeeded", "failure_reason": null, "evidence_span": ""}]}',
    "acceptance-criteria": '{"criteria": [{"text": "Shows #", "required": true}]}',
    "next-action": '{"next_action": "Check #", "confidence": 0.5}',
}


def _answered(prompts: str) -> str:
    """The answers to a table of prompts, with the tokens of both attempts."""
    n = 'length("user")'
    texts = " ".join(f"WHEN '{k}' THEN replace({_sql(v)}, '#', CAST({n} AS VARCHAR))" for k, v in ANSWERS.items())
    return f"""SELECT packet_id, extractor, n, n % 10 <> 0 AS ok,
  CASE WHEN n % 10 = 0 THEN NULL WHEN extractor = 'objective' THEN 'Finish ' || n WHEN extractor = 'next-action' THEN 'Check ' || n END AS value,
  CASE WHEN n % 10 = 0 THEN NULL WHEN extractor = 'objective' THEN 0.75::DOUBLE WHEN extractor = 'next-action' THEN 0.5::DOUBLE END AS confidence,
  (CASE WHEN n % 10 < 2 THEN 2 ELSE 1 END) * CAST(ceil((length(system) + n) / 4.0) AS BIGINT) AS tokens_in,
  CASE n % 10 WHEN 0 THEN 6 WHEN 1 THEN 3 + size ELSE size END AS tokens_out, true AS live
FROM (SELECT *, {n} AS n, CAST(ceil(length(CASE extractor {texts} END) / 4.0) AS BIGINT) AS size FROM {prompts}) p"""


EX = {**CX, "tails": TAIL, "wholes": WHOLE, "recents": RECENT, "prompts": PROMPTS, "answered": _answered("prompts")}


@query("extract_fields", check_sql(
    "SELECT packet_id, extractor, ok, value, confidence, tokens_in, tokens_out, live FROM answered", EX))
def extract_fields(spark, sf):
    found, _ = X.complete_prompts(_prompts(spark, sf), answer_by_length, "rule")
    return found.select("packet_id", "extractor", "ok", "value", "confidence", "tokens_in", "tokens_out",
                          "live")


FULL = {
    **CX, "tails": TAIL, "wholes": WHOLE,
    "prompts1": " UNION ALL ".join([
        _row("objective", {"transcript_excerpt": "excerpt", "ticket_text": "''"}, "compiled JOIN tails ON conv_id = session_id"),
        _row("attempts", {"transcript_excerpt": "excerpt"}, "compiled JOIN wholes ON conv_id = session_id")]),
    "answers1": _answered("prompts1"),
    "merged": """SELECT c.packet_id, c.session_id, coalesce(o.value, c.objective) AS objective, c.current_state, c.next_action,
      coalesce(o.confidence, c.confidence_score) AS confidence_score, a.n AS tried
    FROM compiled c LEFT JOIN answers1 o ON o.packet_id = c.packet_id AND o.extractor = 'objective' AND o.ok
    LEFT JOIN answers1 a ON a.packet_id = c.packet_id AND a.extractor = 'attempts' AND a.ok""",
    "prompts2": " UNION ALL ".join([
        _row("acceptance-criteria", {"objective": "objective", "ticket_text": "''", "transcript_excerpt": "excerpt"}, "merged JOIN tails ON conv_id = session_id"),
        _row("next-action", {"packet_summary": "'Objective: ' || objective || chr(10) || chr(10) || 'Current state: ' || current_state || chr(10) || chr(10) || 'Recent attempts:' || chr(10) || coalesce('  1. Tried ' || tried || chr(10) || '  2. Tried ' || tried || ' again', '(none)')"}, "merged")]),
    "answers2": _answered("prompts2"),
}


@query("compile_full", check_sql("""
SELECT m.packet_id, m.objective, coalesce(x.value, m.next_action) AS next_action, m.confidence_score,
  CASE WHEN m.tried IS NULL THEN 0 ELSE 2 END::BIGINT AS n_attempts, CASE WHEN c.ok THEN 1 ELSE 0 END::BIGINT AS n_criteria
FROM merged m LEFT JOIN answers2 x ON x.packet_id = m.packet_id AND x.extractor = 'next-action' AND x.ok
LEFT JOIN answers2 c ON c.packet_id = m.packet_id AND c.extractor = 'acceptance-criteria'""", FULL))
def compile_full(spark, sf):
    out = X.compile_full(turns(spark, sf), compiled(spark, sf), answer_by_length, "rule", now=NOW)
    n = out["attempts"].groupBy("packet_id").agg(F.count("*").alias("n_attempts"))
    m = out["criteria"].groupBy("packet_id").agg(F.count("*").alias("n_criteria"))
    return out["packets"].join(n, "packet_id", "left").join(m, "packet_id", "left").select(
        "packet_id", "objective", "next_action", "confidence_score",
        F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"),
        F.coalesce("n_criteria", F.lit(0)).alias("n_criteria"),
    )
