"""Secret detection and redaction as column expressions.

Four detectors: private key markers, environment assignments, known token
prefixes, and tokens of high entropy near a keyword. Everything runs in the JVM;
a text without any trigger word is left after one cheap match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import constants as K
from sessionloom.functions.text import WS, let

# Token boundary characters and detector patterns (fixed values).
TOKEN_CHAR = rf"[^,;\x27\x22`<>(){{}}\[\]{WS}]"
PEM = "-----BEGIN [A-Z ]+ PRIVATE KEY-----"
ENV = rf"(?<![^\n])[A-Z][A-Z0-9_]{{3,}}=[^{WS}]{{8,}}(?![^\n])"
LONG_TOKEN = rf"(?<!{TOKEN_CHAR}){TOKEN_CHAR}{{{K.PREFIX_MIN_LENGTH},}}+"
TRIGGER = (
    rf"(?:{'|'.join(K.SECRET_PREFIXES)})|-----BEGIN |(?<![^\n])[A-Z][A-Z0-9_]{{3,}}="
)

HIT = "array<struct<offset:bigint,rank:int,kind:string,length:bigint>>"


def may_hold_secret(text: str) -> Column:
    """Cheap necessary condition for any hit in the column `text`."""
    return F.expr(_trigger(text))


def _trigger(text: str) -> str:
    words = "|".join(K.SECRET_KEYWORDS)
    return f"(lower({text}) rlike '{words}' OR {text} rlike r'{TRIGGER}')"


def entropy_sql(token: str) -> str:
    """Bits per character, rounded so that sums in any order compare alike."""
    p = f"((char_length({token}) - char_length(replace({token}, c, ''))) / char_length({token}))"
    return (
        f"round(aggregate(array_distinct(filter(split({token}, ''), c -> c <> '')), 0D, "
        f"(h, c) -> h - {p} * log2({p})), 9)"
    )


def _hit(rank: int, kind: str) -> str:
    return (
        "named_struct('offset', acc.at + char_length(x.gap), "
        f"'rank', {rank}, 'kind', '{kind}', 'length', cast(char_length(x.hit) as bigint))"
    )


def _matches(text: str, pattern: str, hits: str) -> str:
    """Walk over the matches of `pattern`; the texts between them set the offsets.

    The pieces are bound to a lambda variable, so they are computed once. `hits`
    sees the pair `x` (gap, hit) and the accumulator `acc` (at, hits).
    """
    return f"""transform(array(named_struct(
        'gap', split({text}, r'{pattern}', -1), 'hit', regexp_extract_all({text}, r'{pattern}', 0))),
      p -> aggregate(
        transform(p.hit, (h, i) -> named_struct('gap', p.gap[i], 'hit', h)),
        named_struct('at', 0L, 'hits', cast(array() as {HIT})),
        (acc, x) -> named_struct(
          'at', acc.at + char_length(x.gap) + char_length(x.hit), 'hits', {hits}),
        acc -> acc.hits))[0]"""


def hits_sql(text: str, threshold: float = K.ENTROPY_THRESHOLD) -> str:
    starts = " OR ".join(f"startswith(x.hit, '{p}')" for p in K.SECRET_PREFIXES)
    start = "(acc.at + char_length(x.gap))"
    near = (
        f"lower(substring({text}, int(greatest({start} - {K.KEYWORD_WINDOW}, 0)) + 1, "
        f"int(char_length(x.hit) + {K.KEYWORD_WINDOW} + least({start}, {K.KEYWORD_WINDOW})))) "
        f"rlike '{'|'.join(K.SECRET_KEYWORDS)}'"
    )
    dense = (
        f"(char_length(x.hit) >= {K.ENTROPY_MIN_LENGTH} AND {entropy_sql('x.hit')} >= {threshold} "
        f"AND {near})"
    )

    def all_of(rank: int, kind: str) -> str:
        return f"concat(acc.hits, array({_hit(rank, kind)}))"

    tokens = f"""CASE WHEN {starts} THEN CASE WHEN {dense}
        THEN concat(acc.hits, array({_hit(2, "prefix")}, {_hit(3, "entropy")}))
        ELSE concat(acc.hits, array({_hit(2, "prefix")})) END
      WHEN {dense} THEN concat(acc.hits, array({_hit(3, "entropy")})) ELSE acc.hits END"""
    return f"""array_sort(concat({_matches(text, PEM, all_of(0, "pem"))},
      {_matches(text, ENV, all_of(1, "env"))}, {_matches(text, LONG_TOKEN, tokens)}))"""


def secret_hits(text: str, threshold: float = K.ENTROPY_THRESHOLD) -> Column:
    """`array<struct<offset, rank, kind, length>>` of all hits in the column
    `text`, in text order; `offset` counts characters from 0. Hits of two
    detectors may overlap."""
    return F.expr(
        f"CASE WHEN {_trigger(text)} THEN {hits_sql(text, threshold)} "
        f"ELSE cast(array() as {HIT}) END"
    )


def redact(text: str, threshold: float = K.ENTROPY_THRESHOLD) -> Column:
    """The column `text` with every secret replaced; overlapping hits count as one."""
    return F.expr(redact_sql(text, threshold))


def redact_sql(text: str, threshold: float = K.ENTROPY_THRESHOLD) -> str:
    kept = f"substring({text}, int(acc.at) + 1, int(h.offset - acc.at))"
    return f"""CASE WHEN {_trigger(text)} THEN transform(
      array({hits_sql(text, threshold)}), hs -> CASE WHEN size(hs) = 0 THEN {text} ELSE aggregate(
        hs, named_struct('at', 0L, 'kept', cast(array() as array<string>)),
        (acc, h) -> named_struct('at', greatest(acc.at, h.offset + h.length), 'kept',
          CASE WHEN h.offset >= acc.at
            THEN concat(acc.kept, array(concat({kept}, '{K.REDACTED}'))) ELSE acc.kept END),
        acc -> concat(array_join(acc.kept, ''), substring({text}, int(acc.at) + 1))) END)[0]
      ELSE {text} END"""


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind)
    inner = [getattr(kind, n) for n in ("elementType", "valueType") if hasattr(kind, n)]
    return isinstance(kind, T.StringType) or any(map(_holds_text, inner))


def redact_value_sql(value: str, kind: T.DataType, threshold: float = K.ENTROPY_THRESHOLD, depth: int = 0) -> str:
    """SQL for `value` of any type with the secrets in all its strings replaced: in
    structs, arrays and the values of maps, at every depth. Field names and map keys
    stay, as do nulls and values without text."""
    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StringType):
        return redact_sql(value, threshold)
    at = f"v{depth}"
    if isinstance(kind, T.ArrayType):
        return f"transform({value}, {at} -> {redact_value_sql(at, kind.elementType, threshold, depth + 1)})"
    if isinstance(kind, T.MapType):
        return f"transform_values({value}, (k{depth}, {at}) -> {redact_value_sql(at, kind.valueType, threshold, depth + 1)})"
    quoted = [(f.name.replace("'", "\\'"), "`" + f.name.replace("`", "``") + "`", f.dataType) for f in kind]
    fields = ", ".join(f"'{name}', {redact_value_sql(f'{value}.{path}', t, threshold, depth)}" for name, path, t in quoted)
    return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"


def redact_records(records: DataFrame, threshold: float = K.ENTROPY_THRESHOLD) -> DataFrame:
    """The rows with the secrets in every string of every column replaced, in one projection."""
    name = lambda f: "`" + f.name.replace("`", "``") + "`"
    return records.select(*[F.expr(redact_value_sql(name(f), f.dataType, threshold)).alias(f.name) for f in records.schema])


def tokens(text: Column) -> Column:
    """`array<struct<gap, tok>>`: all maximal runs of token characters, each
    with the text before it."""
    pieces = F.struct(
        F.split(text, rf"{TOKEN_CHAR}++", -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rf"{TOKEN_CHAR}++"), 0).alias("tok"),
    )
    return let(pieces, lambda p: F.arrays_zip(p["gap"], p["tok"]))
