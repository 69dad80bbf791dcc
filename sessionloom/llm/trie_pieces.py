"""Operator 6: SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked as the model asks: one space goes in front, and every space counts
as the model's mark U+2581 (the pieces are kept with spaces here). Marked words are
runs of marks with the characters up to the next mark; no piece of
a model crosses such a border, nor a line feed that no piece holds. The distinct
words of a batch are sorted, which is the depth-first order of their trie. The
forward pass goes along the trie: a word keeps the forward states of the prefix
that it shares with the word before it and adds those of its own tail.

The model in use is a byte-pair one, whose result is the segmentation in which
every two neighbouring pieces, merged as a text of their own, give the same two
pieces. So a path scores 0 if all its neighbours agree and minus infinity if not;
exactly one path to each prefix is finite, and its last piece is the forward state.
The result equals that of the public library, piece by piece. (A sum of the
pieces' scores would give other pieces, as those scores are merge ranks.)

Characters outside the vocabulary become byte pieces. Decoding joins the pieces'
bytes, turns marks into spaces and removes the one in front.

Cases: a null or empty text gives no ids and decodes to an empty text; U+2581 in a
text comes back as a space, as in the library; a null doc_id is kept; repeated rows
give repeated results; an empty table gives an empty result; texts and words of any
length are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import fill_words, map_batches

MARK = "▁"
WORDS = re.compile("\n| *[^ \n]+| +")
#: Distinct words whose pieces a Python worker keeps.
KEPT_WORDS = 250_000
KEPT_PAIRS = 300_000
START, UNKNOWN = -2, -1
_models: dict[str, "Model"] = {}


class Model:
    """The pieces of a byte-pair model with byte fallback, and its forward pass."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace(MARK, " "): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.piece = {i: p for p, i in self.ids.items()}
        self.bytes_of = [b""] * len(ids)
        for p, i in self.ids.items():
            self.bytes_of[i] = p.encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        if any("\n" in p or " " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece of this model crosses a word border")
        self.code = [i.to_bytes(2, "little") for i in ids]
        self.root: dict = {}
        for p, i in self.ids.items():
            node = self.root
            for sign in p:
                node = node.setdefault(sign, {})
            node[""] = i
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The byte-pair result for a short text: best score first, then leftmost."""
        part, after = list(text), list(range(1, len(text) + 1))
        before, heap, n = list(range(-1, len(text) - 1)), [], len(text)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def agrees(self, last: int, piece: int) -> bool:
        """Whether `piece` may follow `last`."""
        right = self.piece[piece]
        left = self.piece[last] if last >= 0 else ""
        return self.merged(left + right) == [left, right] if left else self.merged(right) == [right]

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Piece ids (two bytes each) of sorted words, by one walk over their trie.

        The state of a prefix holds its last piece and where that starts, and the starts
        from which a longer piece may still grow, with their nodes in the pieces' own
        trie. The ids of a word are read by going back from its end."""
        pairs, root, code = self.pairs, self.root, self.code
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        out, before = [], ""
        last, back, grows = [START], [0], [[]]
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1:], back[same + 1:], grows[same + 1:]
            for at in range(same, len(word)):
                sign, found, open_ = word[at], None, []
                for start, node in [*grows[at], (at, root)]:
                    node = node.get(sign)
                    if node is None:
                        continue
                    open_.append((start, node))
                    piece = node.get("")
                    if piece is None or found is not None:
                        continue
                    key = (last[start] + 2) << 20 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.agrees(last[start], piece)
                    if fits:
                        found = start, piece
                if found is None:
                    last.append(UNKNOWN)
                    back.append(at)
                else:
                    last.append(found[1])
                    back.append(found[0])
                grows.append(open_)
            parts, at = [], len(word)
            while at:
                piece, at = last[at], back[at]
                if piece == UNKNOWN:
                    parts.append(b"".join(code[self.byte_ids[b]] for b in word[at].encode("utf-8", "surrogatepass")))
                else:
                    parts.append(code[piece])
            out.append(b"".join(reversed(parts)))
            before = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]

        def lookup(words: list[str]) -> Iterable[bytes]:
            words.sort()
            return self.encode_sorted(words)

        fill_words(marked, self.known, KEPT_WORDS, lookup)
        return [b"".join(map(self.known.__getitem__, w)) for w in marked]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the piece ids of every whole text."""
    return round_trip(docs, model, restore=False).select("doc_id", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""

    def step(cols: dict[str, list]):
        made = _model(model)
        yield cols | {"text": [made.decode(x or []) for x in cols["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, ids array<int>, text string", step)


def round_trip(docs: DataFrame, model: str, restore: bool = True) -> DataFrame:
    """doc_id, ids, n_ids and the SHA-256 of the text that is decoded from the ids
    (null unless `restore`), in one pass over the texts."""

    def step(cols: dict[str, list]):
        made = _model(model)
        for lo in range(0, len(cols["text"]), 1000):
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in made.encode([t or "" for t in cols["text"][lo:lo + 1000]])]
            digest = [hashlib.sha256(made.decode(x.tolist()).encode()).hexdigest() if restore else None for x in ids]
            yield {"doc_id": cols["doc_id"][lo:lo + 1000], "ids": ids, "n_ids": [len(x) for x in ids], "text_sha256": digest}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, "doc_id long, ids array<int>, n_ids long, text_sha256 string", step)
