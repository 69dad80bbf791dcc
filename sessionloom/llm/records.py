"""Operator 1: token ids as length-delimited binary records.

A shard is a sequence of records. All numbers are little-endian:

    u64 length of the payload
    u32 masked CRC-32 of the eight length bytes
    payload
    u32 masked CRC-32 of the payload

    payload = u8 flags (1: doc_id present, 2: ids are 4 bytes wide), i64 doc_id, ids

A mask rotates the checksum by 15 bits and adds a constant, so that a checksum of
data that holds checksums stays meaningful. Ids take two bytes when the vocabulary
allows it. Shards are ranges of doc_id, ascending within and across shards. A
separate offset index (Parquet: doc_id, shard, offset, length, first token) lets a
reader fetch records in any order with one seek each.

Cases: a null text is an empty one and gives just the end id; a null doc_id sorts
first and is kept; rows with one doc_id are ordered by their text; an empty table
gives no shard, no index row and no result; other columns are ignored. A shard is
written under a name of its attempt and then renamed, so a task that runs again
replaces it with the same bytes.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import _arrow, texts_of

MASK_ADD = 0xA282EAD8
HEAD, CRC, LEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
INDEX = "doc_id long, shard int, offset long, length long, n_tokens long, start_in_shard long"
#: Distinct words whose ids a Python worker keeps.
KEPT_WORDS = 1_500_000
#: Characters that are encoded at once, or one text of more.
PART_CHARS = 10_000_000
AFTER_SPACE = re.compile(r"(?<=\S)(?= )")
SPACED = re.compile(r"\s ")
_tokenizers: dict[str, tuple] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = HEAD.pack(len(payload))
    return head + CRC.pack(masked(head)) + payload + CRC.pack(masked(payload))


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return LEAD.pack((doc_id is not None) | 2 * wide, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = LEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=LEAD.size)
    return (doc_id if flags & 1 else None), ids


def records_of(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each record; a damaged one raises ValueError."""
    at = 0
    while head := stream.read(HEAD.size + CRC.size):
        if len(head) < HEAD.size + CRC.size or masked(head[:8]) != CRC.unpack_from(head, 8)[0]:
            raise ValueError(f"damaged record length at byte {at}")
        size = HEAD.unpack_from(head)[0]
        payload, tail = stream.read(size), stream.read(CRC.size)
        if len(payload) < size or len(tail) < 4 or masked(payload) != CRC.unpack(tail)[0]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += len(head) + size + CRC.size


def _tokenizer(path: str) -> tuple:
    """The tokenizer, its known words, its width, and the bytes of each id, once per worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        vocabulary = made.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            sizes[i] = len(piece)  # a character stands for a byte
        _tokenizers[path] = made, {}, "<u4" if len(sizes) > 0x10000 else "<u2", sizes
    return _tokenizers[path]


def chunks_of(text: str) -> list[str]:
    """Cut before every space that follows a non-space: the byte-level splitting
    rule always begins a new piece there, so the chunks encode independently. All
    but the first lose that space."""
    if text[:1] == " " or SPACED.search(text):
        first, *rest = AFTER_SPACE.split(text)
        return [first, *[w[1:] for w in rest]]
    return text.split(" ")


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text. Distinct chunks go through the tokenizer once."""
    made, known, width, sizes = _tokenizer(path)

    def alone(chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, width).tobytes() for e in made.encode_batch_fast(chunks, add_special_tokens=False)]

    def lookup(words: list[str]) -> list[bytes]:
        """Words that do not end in white space are put behind spaces and encoded a few
        thousand at once; the bytes of the ids tell where each word's ids end."""
        odd = [w for w in words if not w or "<|" in w or w[-1].isspace()]
        apart = dict(zip(odd, alone([" " + w for w in odd]), strict=True))
        plain, found = [w for w in words if w not in apart] if odd else words, []
        for lo in range(0, len(plain), 4000):
            part = plain[lo:lo + 4000]
            ids = np.array(made.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, width)
            reach = np.cumsum(1 + pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64))
            ends = np.searchsorted(np.cumsum(sizes[ids]), reach) + 1
            code = ids.tobytes()
            cuts = [0, *(ends * ids.itemsize).tolist()]
            found += [code[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        rest = iter(found)
        return [apart[w] if w in apart else next(rest) for w in words] if odd else found

    chunks = [chunks_of(t) if t else [] for t in texts]
    firsts = iter(alone([c[0] for c in chunks if c]))
    ends = np.cumsum([0, *[max(0, len(c) - 1) for c in chunks]])
    # Each distinct word of these texts is met once as a Python object.
    words = pa.array(itertools.chain.from_iterable(c[1:] for c in chunks), pa.large_string()).dictionary_encode()
    distinct, of = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    codes = list(map(known.get, distinct))
    if fresh := [w for w, code in zip(distinct, codes, strict=True) if code is None]:
        made_now = lookup(fresh)
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
        known.update(zip(fresh, made_now, strict=True))
        new = iter(made_now)
        codes = [next(new) if code is None else code for code in codes]
    ids, cuts = _gathered(codes, of, width)
    return [
        (next(firsts) if c else b"") + ids[cuts[a]:cuts[b]].tobytes()
        for c, a, b in zip(chunks, ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]


def _gathered(codes: list[bytes], of: np.ndarray, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words codes[of], one after the other, and where each word's begin and end."""
    flat = np.frombuffer(b"".join(codes), width)
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // np.dtype(width).itemsize
    cuts = np.append(0, np.cumsum(size[of]))
    shift = (np.cumsum(size) - size)[of] - cuts[:-1]
    return flat[np.repeat(shift, size[of]) + np.arange(cuts[-1])], cuts


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Cuts of the texts, after 2,000 of them or PART_CHARS characters."""
    lo = size = 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= PART_CHARS or i - lo == 2000 or i == len(texts):
            yield lo, i
            lo, size = i, 0


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text) into shards below `out_dir` and return the offset index."""
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = (
        texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
        .repartitionByRange(count, F.col("doc_id").asc_nulls_first(), tie, F.monotonically_increasing_id())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    )
    arrow = _arrow(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, offset, tokens, out, store, name = task.partitionId(), 0, 0, None, None, ""
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines: dict[str, list] = {k: [] for k in arrow.names}
            for lo, hi in _parts(texts):
                width = _tokenizer(tokenizer)[2]
                end = np.array([end_id], width).tobytes()
                framed = []
                for doc_id, code in zip(ids[lo:hi], encode_texts(texts[lo:hi], tokenizer), strict=True):
                    record = frame(pack(doc_id, code + end, width == "<u4"))
                    n = len(code) // len(end) + 1
                    for k, v in zip(lines, (doc_id, shard, offset, len(record), n, tokens), strict=True):
                        lines[k].append(v)
                    offset, tokens = offset + len(record), tokens + n
                    framed.append(record)
                if out is None:
                    store, name = fs.FileSystem.from_uri(f"{out_dir}/records/part-{shard:06d}")
                    store.create_dir(name.rpartition("/")[0])
                    out = store.open_output_stream(f"{name}.{task.taskAttemptId()}")
                out.write(b"".join(framed))
            yield pa.RecordBatch.from_pydict(lines, schema=arrow)
        if out is not None:
            out.close()
            store.move(f"{name}.{task.taskAttemptId()}", name)

    rows.mapInArrow(run, INDEX).write.parquet(f"{out_dir}/index")
    return spark.read.schema(INDEX).parquet(f"{out_dir}/index")


def read_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard and offset of every record, from the shards."""
    index = spark.read.schema(INDEX).parquet(f"{out_dir}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard file, a number that Spark's settings choose.
    starts = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*[batch.column(i).to_pylist() for i in (0, 1)], strict=True):
                store, name = fs.FileSystem.from_uri(f"{out_dir}/records/part-{shard:06d}")
                lines: dict[str, list] = {k: [] for k in arrow.names}
                with store.open_input_stream(name, buffer_size=1 << 20) as stream:
                    for at, payload in records_of(stream):
                        doc_id, ids = unpack(payload)
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        for k, v in zip(lines, (doc_id, base, len(ids), crc, shard, at), strict=True):
                            lines[k].append(v)
                        base += len(ids)
                        if len(lines["shard"]) == 5000:
                            yield pa.RecordBatch.from_pydict(lines, schema=arrow)
                            lines = {k: [] for k in arrow.names}
                yield pa.RecordBatch.from_pydict(lines, schema=arrow)

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(count).mapInArrow(run, schema)


def fetch(out_dir: str, shard: int, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry: a seek and a read."""
    store, name = fs.FileSystem.from_uri(f"{out_dir}/records/part-{shard:06d}")
    with store.open_input_file(name) as stream:
        stream.seek(offset)
        return unpack(next(records_of(pa.BufferReader(stream.read(length))))[1])
