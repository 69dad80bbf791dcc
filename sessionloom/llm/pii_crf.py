"""Operator 4: personal data by a semi-Markov conditional random field.

Base spans come from four fixed patterns. The field adds spans of the same kinds in
other forms and secrets. It looks at islands: the stretch around digits and "@",
cut into tokens (runs of word characters, single signs). A candidate segment is at
most MAX_TOKENS tokens and MAX_CHARS characters long; it is scored as a whole, by
features of its shape, length, checksum, borders and the word before it. Dynamic
programming over segments, whose length is thus bounded, chooses borders and types
together; all that lies outside an island or has no candidate is "other", whose
score is 0, so nothing is lost by not looking there. Tokens of base spans are fixed
and no added span overlaps them.

The field is trained here by gradient steps on its conditional likelihood, on
LABELLED sentences that `examples` draws from rules with a fixed seed: entities in
several forms, and look-alikes (dates, versions, prices, counts, failed checksums).

Cases: a null or empty text has no spans; repeated rows give repeated results; a
null doc_id is kept; an empty table gives an empty result; texts of any length are
searched whole, in linear time: an island, however long, is read column by column, with
some 60 bytes kept for each token. Positions are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import map_batches, slices

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TOKENS, MAX_CHARS, LABELLED, SEED = 14, 96, 700, 20
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only; later starts fail in the same place.
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    n = [ord(c) - 48 for c in reversed(digits)]
    return sum(n[::2] + [double[x] for x in n[1::2]]) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and without overlap within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isascii, filter(str.isdigit, m[0]))) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# The field.

TRIGGER = re.compile("[0-9@]+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
CUES = {
    "phone": ("tel", "phone", "call", "mobile", "fax"), "card": ("card", "visa", "credit"), "ip": ("ip", "host", "server"),
    "secret": ("token", "secret", "password", "key", "apikey", "pwd"), "email": ("mail", "email", "contact"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that hold all segments with a digit or "@", and their context."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=100_000)
def _shape(span: str) -> tuple[str, ...]:
    """Features of the whole span that do not depend on its place."""
    digits = re.sub("[^0-9]", "", span)
    letters, n = sum(map(str.isalpha, span)), len(digits)
    runs = re.sub(r"X+", "X", re.sub(r"[^\W\d_]+", "A", re.sub(r"[0-9]+", "9", span)).replace("A9", "X9").replace("9A", "9X"))
    signs = re.sub(r"[^\W_]+", "w", span)
    f = [f"signs:{signs}" if len(signs) < 16 else "signs:long", f"digits:{min(n, 20)}", f"letters:{min(letters, 3) + 3 * (letters > 8)}"]
    if letters == 0:
        f += [f"digits-only:{n}", f"groups:{'-'.join(str(len(g)) for g in re.findall('[0-9]+', span))[:20]}"]
    if "@" in span:
        f.append("at" if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", span) else "at-odd")
    if span[0] in "+(":
        f.append(f"first:{span[0]}")
    if 12 <= n <= 19 and not letters:
        f.append("checksum" if luhn(digits) else "no-checksum")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
        f.append("quad" if all(int(p[:4]) <= 255 for p in span.split(".")) else "no-quad")
    if signs == "w" and letters:
        kinds = len({c.isdigit() for c in span}) + (span.lower() != span and span.upper() != span)
        f += [f"word:{min(len(span) // 8, 5)}:{kinds}", "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", span) else "not-hex"]
    if len(runs) < 12:
        f.append(f"runs:{runs}")
    return tuple(f)


class Lattice:
    """Tokens of a stretch, and its candidate segments with their features. Segments are
    made column by column, so that a long stretch never holds all of them."""

    def __init__(self, text: str, lo: int, hi: int, fixed: list[tuple[int, int]] = ()):
        """fixed: disjoint spans in order that no segment may touch."""
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in TOKEN.finditer(text, lo, hi):
            # A token that the stretch cuts is no place for a border.
            if lo and m.start() == lo and text[lo - 1].isalnum() or hi < len(text) and m.end() == hi and text[hi].isalnum():
                continue
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.shut, self.live, self.cues = bytearray(), bytearray(), []
        cue, at = "", 0
        for a, b in zip(self.starts, self.ends, strict=True):
            while at < len(fixed) and fixed[at][1] <= a:
                at += 1
            self.shut.append(at < len(fixed) and fixed[at][0] < b)
            self.live.append(TRIGGER.search(text, a, b) is not None)
            self.cues.append(cue)
            cue = CUE_OF.get(text[a:b].lower(), cue if not text[a].isalnum() else "")

    def __len__(self) -> int:
        return len(self.starts)

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.starts[i], self.ends[j - 1]

    def column(self, j: int) -> list[tuple[int, str, tuple[str, ...]]]:
        """First token, text and features of place of the segments that end before token j."""
        text, out = self.text, []
        if not j or not text[(b := self.ends[j - 1]) - 1].isalnum():
            return out
        live, right = False, "end" if b == len(text) else "space" if text[b].isspace() else f"sign{text[b]}"
        goes_on = right[:4] == "sign" and b + 1 < len(text) and text[b + 1].isalnum()
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            a = self.starts[i]
            if self.shut[i] or b - a > MAX_CHARS or i < j - 1 and self.starts[i + 1] - self.ends[i] > 1:
                break
            live = live or bool(self.live[i])
            if not live or not (text[a].isalnum() or text[a] in "+(") or a and text[a - 1].isalnum() or text[a] == "(" and j - i < 4:
                continue
            left = "start" if a == 0 else "space" if text[a - 1].isspace() else f"sign{text[a - 1]}"
            near = [f"left:{left}", f"right:{right}", f"cue:{self.cues[i]}"]
            if goes_on:
                near.append("goes-on")
            if left[:4] == "sign" and a > 1 and text[a - 2].isalnum():
                near.append("came-on")
            out.append((i, text[a:b], tuple(near)))
        return out[::-1]


class Field:
    """Weights by feature and type, and by neighbouring types (0 is "other")."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.next = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.shapes: dict[str, np.ndarray] = {}
        self.places: dict[tuple[str, ...], np.ndarray] = {}

    def numbered(self, lattice: Lattice, grow: bool = False) -> list[list[tuple[int, np.ndarray]]]:
        """All segments with the numbers of their features, for training."""
        named = [[(i, ("bias", *_shape(span), *near)) for i, span, near in lattice.column(j)] for j in range(len(lattice) + 1)]
        if grow:
            for segments in named:
                for _, names in segments:
                    for f in names:
                        self.index.setdefault(f, len(self.index))
        return [
            [(i, np.array([self.index[f] for f in names if f in self.index], np.int64)) for i, names in segments]
            for segments in named
        ]

    def weight(self, known: dict, key, names: Callable[[], tuple[str, ...]]) -> np.ndarray:
        """The summed weights of the features `names()`, kept under `key`; the memory
        for them is bounded and has no effect on results."""
        if (found := known.get(key)) is None:
            if len(known) >= 100_000:
                known.clear()
            found = known[key] = self.w[[self.index[f] for f in names() if f in self.index]].sum(0)
        return found

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """Segments (first token, end token, type) of the best path. Scores are kept for
        the last MAX_TOKENS columns, back pointers as numbers for all."""
        n, t = len(lattice), len(KINDS) + 1
        score = np.full((MAX_TOKENS + 1, t), -np.inf)
        score[0, 0] = 0
        start, before = np.zeros((n + 1, t), np.int32), np.zeros((n + 1, t), np.int8)
        for j in range(1, n + 1):
            here = np.full(t, -np.inf)
            from_other = score[(j - 1) % len(score)] + self.next[:, 0]
            before[j, 0] = from_other.argmax()
            here[0], start[j, 0] = from_other[before[j, 0]], j - 1
            for i, span, near in lattice.column(j):
                reach = score[i % len(score)][:, None] + self.next[:, 1:]
                own = self.weight(self.shapes, span, lambda s=span: ("bias", *_shape(s))) + self.weight(self.places, near, lambda n=near: n)
                value = reach.max(0) + own
                better = np.flatnonzero(value > here[1:])
                if len(better):
                    here[better + 1], start[j, better + 1], before[j, better + 1] = value[better], i, reach.argmax(0)[better]
            score[j % len(score)] = here
        out, at, y = [], n, int(score[n % len(score)].argmax())
        while at:
            i, kind = int(start[at, y]), int(before[at, y])
            if y:
                out.append((i, at, y - 1))
            at, y = i, kind
        return out[::-1]

    def gradient(self, segments: list, gold: set[tuple[int, int, int]], gw: np.ndarray, gt: np.ndarray) -> None:
        """Add observed minus expected counts of one stretch."""
        n, t = len(segments) - 1, len(KINDS) + 1
        own = [[self.w[f].sum(0) for _, f in some] for some in segments]
        alpha = np.full((n + 1, t), -np.inf)
        alpha[0, 0] = 0
        into = np.full((n + 1, t), -np.inf)
        lse = lambda x: np.logaddexp.reduce(x, axis=0)
        for j in range(n + 1):
            if j:
                alpha[j, 0] = into[j - 1, 0]
            for (i, _), s in zip(segments[j], own[j], strict=True):
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], into[i, 1:] + s)
            into[j] = lse(alpha[j][:, None] + self.next)
        beta = np.full((n + 1, t), -np.inf)
        beta[n] = 0
        starts: list[list] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for (i, f), s in zip(segments[j], own[j], strict=True):
                starts[i].append((j, f, s))
        total = lse(alpha[n])
        for i in range(n - 1, -1, -1):
            out = np.full(t, -np.inf)  # by the type of the segment that begins at i
            out[0] = beta[i + 1, 0]
            for j, f, s in starts[i]:
                value = s + beta[j, 1:]
                out[1:] = np.logaddexp(out[1:], value)
                p = np.exp(into[i, 1:] + value - total)
                np.add.at(gw, f, -p)
            pair = alpha[i][:, None] + self.next + out
            beta[i] = np.logaddexp.reduce(self.next + out, axis=1)
            gt -= np.exp(pair - total)
        before, at = 0, 0
        by_start = {i: (j, y) for i, j, y in gold}
        while at < n:
            if at in by_start:
                j, y = by_start[at]
                f = next(f for i, f in segments[j] if i == at)
                gw[f, y] += 1
                gt[before, y + 1] += 1
                before, at = y + 1, j
            else:
                gt[before, 0] += 1
                before, at = 0, at + 1


def examples(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with labelled spans, drawn from rules."""
    rng = random.Random(seed)
    syllables = "an the re ti on ou er st en ha le de sch che ción que eau é ß lo mi to ra ve in".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def number(n: int, good: bool) -> str:
        while luhn(d := rng.choice("3456") + digits(n - 1)) != good:
            pass
        return d

    def grouped(d: str, sign: str) -> str:
        return sign.join(d[i:i + 4] for i in range(0, len(d), 4))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            name = rng.choice([word(), f"{word()}.{word()}", f"{word()}_{digits(2)}", f"{word()}.{digits(2)}"])
            return kind, f"{name}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = number(rng.choice([15, 16, 16, 19]), True)
            return kind, rng.choice([d, d, grouped(d, " "), grouped(d, "-"), grouped(d, ".")])
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"])
        length = rng.choice([24, 32, 40, 40, 48])
        return kind, "".join(rng.choices(rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]), k=length)) + "7a"

    def other() -> str:
        d = digits
        return rng.choice([
            f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}", f"${d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}",
            d(rng.randint(1, 12)), number(16, False), number(15, False), f"#{d(5)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}%", f"@{word()}", f"{word()}{d(3)}",
            f"{d(3)}-{d(2)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(4)}", f"p.{d(3)}", f"{word()}@", f"{rng.randint(256, 999)}.{d(2)}.{d(1)}.{d(3)}",
            f"{d(1)}.{d(1)}.{d(2)}.{d(1)}.{d(2)}", f"{d(3)} {d(3)}", f"{d(4)} {d(4)}", f"[{d(2)}]", f"{word()}-{d(4)}", f"{d(14)}", f"{d(20)}",
            f"{word()}{word()}{word()}{word()}{word()}{word()}{word()}{d(1)}", f"({d(4)})", f"{d(2)}.{d(3)}.{d(3)}",
        ])

    out = []
    for _ in range(count):
        text, spans = word(), []
        for _ in range(rng.randint(1, 3)):
            text += "".join(f"{rng.choice([' ', ' ', ' ', ', ', '. '])}{word()}" for _ in range(rng.randint(0, 6)))
            if rng.random() < 0.5:
                kind, value = entity()
                if rng.random() < 0.4 or kind == "secret" and rng.random() < 0.8:
                    text += f" {rng.choice(CUES[kind])}{rng.choice([' ', ': ', '='] if kind != 'secret' else [': ', '=', ' = ', ' '])}"
                    open_sign = rng.choice(["", '"'] if kind == "secret" else [""])
                else:
                    text += rng.choice([" ", " ", " ", " (", " <", "\n", "### "])
                    open_sign = ""
                text += open_sign
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + open_sign
            else:
                text += f"{rng.choice([' ', ' ', ' (', '\n'])}{other()}"
            text += rng.choice(["", "", ".", ",", ")", "###", "$$$", ";"])
        out.append((f"{text} {word()}", spans))
    return out


def _gold(lattice: Lattice, spans: list[Span]) -> set[tuple[int, int, int]] | None:
    starts = {a: i for i, a in enumerate(lattice.starts)}
    ends = {b: i + 1 for i, b in enumerate(lattice.ends)}
    found = {(starts.get(a, -1), ends.get(b, -1), KINDS.index(k)) for k, a, b in spans}
    good = all(j > 0 and any(x == i for x, *_ in lattice.column(j)) for i, j, _ in found)
    return found if good else None


@functools.lru_cache(maxsize=4)
def trained(count: int = LABELLED, seed: int = SEED, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Adaptive gradient steps, 16 sentences each, in a fixed order."""
    field, data = Field(), []
    for text, spans in examples(count, seed):
        lattice = Lattice(text, 0, len(text))
        gold = _gold(lattice, spans)
        if gold is not None:
            data.append((field.numbered(lattice, grow=True), gold))
    field.w = np.zeros((len(field.index), len(KINDS)))
    sum_w, sum_t = np.full_like(field.w, 1e-2), np.full_like(field.next, 1e-2)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for lo in range(0, len(data), 16):
            gw, gt = -decay * field.w, -decay * field.next
            for segments, gold in data[lo:lo + 16]:
                field.gradient(segments, gold, gw, gt)
            sum_w += gw * gw
            sum_t += gt * gt
            field.w += rate * gw / np.sqrt(sum_w)
            field.next += rate * gt / np.sqrt(sum_t)
    return field


def added_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    out: list[Span] = []
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    first = 0
    for lo, hi in islands(text):
        while first < len(taken) and taken[first][1] <= lo:
            first += 1
        end = bisect.bisect_left(taken, [hi], first)
        lattice = Lattice(text, lo, hi, taken[first:end])
        out += [(KINDS[y], *lattice.span(i, j)) for i, j, y in field.best(lattice)]
    return out


def written(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def spans_of(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of each text."""
    made = field or trained()

    def step(cols: dict[str, list]):
        out: dict[str, list] = {k: [] for k in ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            base = base_spans(text or "")
            more = added_spans(text or "", made, base)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            for k, v in zip(out, (doc_id, *counts, digest, written(base + more), len(more)), strict=True):
                out[k].append(v)
        yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, f"doc_id long, {SCHEMA}", step)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of `docs` with every span replaced by its kind in brackets, and
    `n_chars` (if there) counted anew; a null text stays null."""
    made, at = field or trained(), docs.columns.index("text")

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        base = base_spans(value)
        out, done = [], 0
        # Overlapping base spans of several kinds are replaced as one.
        for kind, a, b in sorted(base + added_spans(value, made, base), key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [value[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join(out) + value[done:] if out else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array(map(clean, batch.column(at).to_pylist()), batch.schema.types[at])
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
