"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import blocked_rank, chat_windows, lm_backoff, mixing, nn_descent, pii_crf, records, repair, runs_index, simhash_vp, suffix_repeats, trie_pieces, url_filter
from sessionloom.llm.common import materialize, table, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return records.read_records(spark, out)


@query
def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.judged(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


@query
def op6_trie_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digest of the text that is decoded from them."""
    return trie_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for n, role in enumerate(("user", "assistant"))
    ])))
    written = materialize(chat_windows.windows(given.union(more)), "chat")
    return chat_windows.digests(chat_windows.parsed(written))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judged(table(spark, sf_dir, "pages"), "page_id", url_filter.RULES, weights, intercept)


@query
def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.spans_of(table(spark, sf_dir, "documents"))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '{chat_windows.ESCAPE}', '{chat_windows.ESCAPE}0')"
    for i, control in enumerate(chat_windows.CONTROL, 1):
        out = f"replace({out}, '{control}', '{chat_windows.ESCAPE}{i}')"
    return out


CHECKS["op5_chat_windows"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS seq,
    CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens,
    16 + length({_escaped_sql("role")}) + length({_escaped_sql("text")}) AS piece FROM c),
p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t),
q AS (
  SELECT *, start + tokens AS stop,
    2 * (start // 1024) + CASE WHEN (start + tokens - 1) // 1024 > start // 1024 THEN 1 ELSE 0 END AS win FROM p),
w AS (SELECT conv_id, win, min(start) AS b, min(seq) AS first_seq FROM q GROUP BY ALL),
s AS (SELECT conv_id, min(seq) AS seq, arg_min(piece, seq) AS piece FROM q WHERE role = 'system' GROUP BY ALL),
h AS (
  SELECT q.conv_id, sum(q.piece) AS n
  FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.stop <= w.b AND q.start >= w.b - 256
  LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE s.seq IS NULL OR s.seq <> q.seq GROUP BY ALL),
k AS (
  SELECT w.conv_id, count(*) * 3 + sum(CASE WHEN w.first_seq > s.seq THEN s.piece ELSE 0 END) AS n
  FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY ALL),
d AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(piece) AS n FROM q GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (d.n + coalesce(h.n, 0) + k.n)::BIGINT AS formatted_chars
FROM d LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM d.conv_id JOIN k ON k.conv_id IS NOT DISTINCT FROM d.conv_id
"""


#: Words of the corpus are mixed so that no source is read more than this often.
MIX_REPEATS = 2.0


@query
def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), repeats=MIX_REPEATS)


CHECKS["op2_temperature_mix"] = """
WITH RECURSIVE u AS (
  SELECT coalesce(source, '') AS source, doc_id,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n_tokens, count(*) AS n
  FROM documents GROUP BY ALL),
t AS (SELECT source, sum(n_tokens * n)::BIGINT AS tokens FROM u GROUP BY source),
g AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS most FROM t),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(least / most, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN pow(least / most, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM bisect, g WHERE i < 40),
e AS (
  SELECT CASE WHEN pow(least / most, -1) <= 2.0 THEN 0.0 ELSE least(1.0, ceil(hi * 10000) / 10000) END AS a
  FROM bisect, g WHERE i = 40),
w AS (SELECT source, tokens, pow(tokens / total, a) AS power, total, most, a FROM t, g, e),
z AS (SELECT sum(power) AS z, ceil(any_value(total) * sum(power) * pow(any_value(most) / any_value(total), 1 - any_value(a)))::BIGINT AS budget FROM w),
s AS (
  SELECT source, w.tokens, greatest(floor(round(power / z, 9) * z.budget::DOUBLE)::BIGINT, w.tokens) AS budget, z.budget AS whole FROM w, z),
r AS (
  SELECT u.*, s.tokens, s.budget, s.whole, unnest(range(0, (s.budget - 1) // s.tokens + 1)) AS pass FROM u JOIN s USING (source)),
k AS (
  SELECT *, md5('1|' || pass || '|' || coalesce(doc_id::VARCHAR, '-') || '|' || n_tokens) AS key FROM r),
p AS (
  SELECT *, pass * tokens + coalesce(sum(n_tokens * n) OVER (
    PARTITION BY source, pass ORDER BY key, doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM k),
b AS (
  SELECT *, ((spot::HUGEINT * ceil(whole / 1048576.0)::BIGINT) // budget)::BIGINT AS block, md5('1|b|' || key || '|' || source) AS inside
  FROM p WHERE spot < budget)
SELECT source, doc_id, n_tokens::BIGINT AS n_tokens, n::BIGINT AS "rows", pass::BIGINT AS pass, block,
  row_number() OVER (PARTITION BY block ORDER BY inside, source, doc_id NULLS FIRST, n_tokens) AS place
FROM b
"""


@query
def op8_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.scored(table(spark, sf_dir, "documents"))


@query
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op12_blocked_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_rank.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


CHECKS["op12_blocked_rank"] = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM words),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (
  SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM words)
  WHERE term IN (SELECT term FROM item) GROUP BY doc, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, size GROUP BY term),
impact AS (
  SELECT doc_id, doc, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms)::BIGINT * docs) // total)) AS impact
  FROM tf JOIN words USING (doc), size),
scored AS (
  SELECT item_id, doc_id, doc, sum(w * impact)::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS "rank", doc_id, score
FROM scored WHERE score > 0 QUALIFY "rank" <= 10
"""


@query
def op11_ida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(given), given)


@query
def op13_runs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_index.deduplicated(table(spark, sf_dir, "documents"))
