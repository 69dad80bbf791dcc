"""Text expressions with the exact white-space and length rules of the data model.

Spark's `trim` strips spaces only and Java's `\\s` is ASCII only, so the
white-space class is spelled out. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom import constants as K

# White space of the text rules (fixed values), as the inside of a character class.
_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS_PLAIN = r"\t\n\x{0b}\f\r \x{a0}" + _WIDE
# The same class for Java: characters below 256 are settled by one bit set and one
# range test, which is ten times faster than a row of single tests.
WS = rf"\s\xa0[\x{{1680}}-\x{{feff}}&&[{_WIDE}]]"

# The same characters as a string.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once so that lambdas below reuse the computed value."""
    return F.transform(F.array(value), body)[0]


def full_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def left_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+", "")


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+\z", "")


def non_blank(c: Column) -> Column:
    """Trimmed text, or NULL when nothing is left (falls through `coalesce`)."""
    t = full_trim(c)
    return F.when(t != "", t)


def one_line(c: Column) -> Column:
    return full_trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def token_estimate(chars: Column) -> Column:
    """Tokens of a text of `chars` characters."""
    return F.ceil(chars / F.lit(4)).cast("bigint")


def capped(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) <= limit, c).otherwise(
        F.concat(F.left(c, F.lit(limit)), F.lit(K.TRUNCATED))
    )


def derive_title(seed: Column) -> Column:
    flat = one_line(seed)
    short = F.when(
        F.char_length(flat) > 80, F.concat(F.left(flat, F.lit(77)), F.lit("..."))
    ).otherwise(flat)
    return F.when(F.char_length(short) >= 3, short).otherwise(K.UNTITLED)


def is_tool_placeholder(c: Column) -> Column:
    t = full_trim(c)
    return t.rlike(rf"\A\[tool:[^\]]+\][{WS}]*\z") | t.startswith("[tool_result]")


def clean_source(c: Column) -> Column:
    kept = F.left(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), F.lit(64))
    return F.coalesce(F.when(kept != "", kept), F.lit("unknown"))


def payload_format(c: Column) -> Column:
    t = full_trim(c)
    looks_json = t.startswith("{") | t.startswith("[")
    return (
        F.when(looks_json & F.try_parse_json(t).isNotNull(), "json")
        .when(looks_json, "text")
        .otherwise("markdown")
    )


def escape_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def interpolate(template: str, values: dict[str, Column]) -> Column:
    """Fill `{{name}}` places in one pass; an unknown name stays visible.

    The template is cut at its places, so inserted text is never scanned again.
    """
    import re

    out: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}", template):
        out.append(F.lit(template[at : m.start()]))
        name = m.group(1)
        if name in values:
            out.append(F.coalesce(values[name], F.lit("")))
        else:
            out.append(F.lit("{{" + name + "}}<<missing>>"))
        at = m.end()
    out.append(F.lit(template[at:]))
    return F.concat(*out)


def word_hit(c: Column, words: list[str], open_words: list[str] = ()) -> Column:
    """Whole-word, case-insensitive hit with ASCII word boundaries."""
    start, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    pattern = f"{start}(?:{'|'.join(words)}){end}"
    if open_words:
        pattern += f"|{start}(?:{'|'.join(open_words)})"
    return c.rlike(f"(?i){pattern}")


def classify_outcome(c: Column) -> Column:
    return (
        F.when(word_hit(c, K.FAILURE_HINTS), "failure")
        .when(word_hit(c, K.INCOMPLETE_HINTS), "incomplete")
        .when(word_hit(c, K.SUCCESS_HINTS, K.SUCCESS_OPEN_HINTS), "success")
        .otherwise("unknown")
    )


def has_limit_marker(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(K.LIMIT_MARKERS))


def first_limit_marker(c: Column) -> Column:
    hit = F.regexp_extract(c, "(?i)(" + "|".join(K.LIMIT_MARKERS) + ")", 1)
    return F.when(hit != "", hit)


def unsafe_ref(ref: Column) -> Column:
    """'absolute', 'traversal' or NULL.

    Only a leading run of parent steps survives path normalization of a
    relative path, so a running depth that falls below zero means traversal.
    """
    depth = F.aggregate(
        F.split(ref, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda acc, part: F.struct(
            F.when(part.isin("", "."), acc["depth"])
            .when(part == "..", F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"] + 1)
            .alias("depth"),
            (acc["out"] | ((part == "..") & (acc["depth"] == 0))).alias("out"),
        ),
    )
    return F.when(ref.startswith("/"), "absolute").when(depth["out"], "traversal")


def first_json_object(raw: Column) -> Column:
    """Strip code fences and leading prose around a JSON object.

    Each step is bound once (`let`), so the expression stays small.
    """
    def unfence(t: Column) -> Column:
        cut = F.locate("\n", t)
        inner = F.when(cut > 0, t.substr(cut + 1, F.char_length(t))).otherwise(t)
        body = let(inner, lambda x: full_trim(
            F.when(x.endswith("```"), F.left(x, F.char_length(x) - 3)).otherwise(x)))
        return F.when(t.startswith("```"), body).otherwise(t)

    def braces(s: Column) -> Column:
        at = F.struct(
            F.locate("{", s).alias("open"),
            (F.char_length(s) - F.locate("}", F.reverse(s)) + 1).alias("close"),
            F.contains(s, F.lit("}")).alias("closed"),
        )
        return F.when(s.startswith("{"), s).otherwise(let(at, lambda p: F.when(
            (p["open"] > 0) & p["closed"] & (p["close"] > p["open"]),
            s.substr(p["open"], p["close"] - p["open"] + 1)).otherwise(s)))

    return let(let(full_trim(raw), unfence), braces)
