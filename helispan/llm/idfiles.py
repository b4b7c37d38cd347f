"""Token-id files of patched frame-of-reference blocks.

The documents are put in ascending order of ``doc_id`` by a range partitioning; each task encodes
its documents and writes a run of chunks. A chunk holds whole documents in blocks of 128 ids: a
block stores its least id, a bit width chosen as a percentile of its differences' widths, the packed
differences, and the ids that need more bits as exceptions. An index holds where each block's words
and exceptions begin, so that a block can be read alone. Chunks are rows of Parquet files, written and
committed by Spark, with the ids and lengths of their documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches
from helispan.llm.tokens import WORD_BPE, encoder
from helispan.session import shared_path

BLOCK = 128
END_ID = 2
#: Share of a block's differences that fit its width.
FIT = 0.9
#: A chunk is closed at so many ids; a longer document is a chunk of its own.
CHUNK = 1 << 19
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIIII")


def compress(ids: np.ndarray) -> bytes:
    """A chunk of unsigned 32-bit ids as patched frame-of-reference blocks."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.zeros(blocks * BLOCK, dtype=np.uint32)
    v[:n] = ids
    if n:
        v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    least = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    gap = v - least[:, None]
    bits = np.frexp(gap.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, int(FIT * (BLOCK - 1)), axis=1)[:, int(FIT * (BLOCK - 1))] if blocks else np.zeros(0, np.uint8)
    odd = bits > width[:, None]
    where = np.flatnonzero(odd)
    gap[odd] = 0
    word_at = np.zeros(blocks + 1, dtype=np.uint32)
    np.cumsum(width.astype(np.uint32) * np.uint32(BLOCK // 32), out=word_at[1:])
    odd_at = np.zeros(blocks + 1, dtype=np.uint32)
    np.cumsum(odd.sum(axis=1), out=odd_at[1:])
    words = np.zeros(int(word_at[-1]), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        g = np.ascontiguousarray(gap[own].T)
        out = np.zeros((w * BLOCK // 32, len(own)), dtype=np.uint32)
        for k in range(BLOCK):
            j, s = divmod(k * w, 32)
            out[j] |= g[k] << np.uint32(s)
            if s + w > 32:
                out[j + 1] |= g[k] >> np.uint32(32 - s)
        words[word_at[own][:, None] + np.arange(len(out), dtype=np.uint32)] = out.T
    return b"".join([
        _HEAD.pack(MAGIC, n, blocks, len(words), len(where)), least.astype("<u4").tobytes(), width.tobytes(),
        word_at.astype("<u4").tobytes(), odd_at.astype("<u4").tobytes(), words.astype("<u4").tobytes(),
        (where % BLOCK).astype(np.uint8).tobytes(), v.reshape(-1)[where].astype("<u4").tobytes(),
    ])


def expand(data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, n, blocks, n_words, n_odd = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    least, width, word_at, odd_at = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
    words, place, value = take("<u4", n_words), take("u1", n_odd), take("<u4", n_odd)
    v = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed = np.ascontiguousarray(words[word_at[own][:, None] + np.arange(w * BLOCK // 32, dtype=np.uint32)].T)
        out = np.empty((BLOCK, len(own)), dtype=np.uint32)
        mask = np.uint32((1 << w) - 1)
        for k in range(BLOCK):
            j, s = divmod(k * w, 32)
            x = packed[j] >> np.uint32(s)
            if s + w > 32:
                x = x | packed[j + 1] << np.uint32(32 - s)
            out[k] = x & mask
        v[own] = out.T
    v += least[:, None]
    v[np.repeat(np.arange(blocks), np.diff(odd_at.astype(np.int64))), place] = value
    return v.reshape(-1)[:n]


def expand_block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block of a chunk, found by the index and read alone."""
    _, n, blocks, n_words, n_odd = _HEAD.unpack_from(data)
    at = _HEAD.size
    least_at, width_at, word_at, odd_at = at, at + 4 * blocks, at + 5 * blocks, at + 9 * blocks + 4
    words_at = at + 13 * blocks + 8
    place_at = words_at + 4 * n_words

    def read(kind: str, place: int, count: int = 1) -> np.ndarray:
        return np.frombuffer(data, dtype=kind, count=count, offset=place)

    width = int(read("u1", width_at + number)[0])
    v = np.full(BLOCK, read("<u4", least_at + 4 * number)[0], dtype=np.uint32)
    if width:
        packed = read("<u4", words_at + 4 * int(read("<u4", word_at + 4 * number)[0]), width * BLOCK // 32)
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").reshape(BLOCK, width)
        v += bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    first, end = read("<u4", odd_at + 4 * number, 2).tolist()
    v[read("u1", place_at + first, end - first)] = read("<u4", place_at + n_odd + 4 * first, end - first)
    return v[: min(BLOCK, n - number * BLOCK)]


def write_ids(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, kind: str = "word", end_id: int = END_ID) -> None:
    """Encode all documents and write their ids below ``path`` in ascending order of ``doc_id``.

    A null or empty text is its end id alone; null ids come first; repeated ids are kept, in the order
    of their texts; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        ids: list[bytes] = []
        docs_here: list[int | None] = []
        held = start = number = 0

        def close() -> pa.RecordBatch:
            lengths = [len(b) // 4 for b in ids]
            row = ([part], [number], [start], [held], [docs_here], [lengths], [compress(np.frombuffer(b"".join(ids), dtype="<u4"))])
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(encode(text) + end)
                docs_here.append(doc)
                held += len(ids[-1]) // 4
                if held >= CHUNK:
                    yield close()
                    start, number, held, ids, docs_here = start + held, number + 1, 0, [], []
        if ids:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 16).alias("begins"), F.monotonically_increasing_id().alias("row"))
    # Ranges within one id: by the beginning of its texts, which agrees with their order, and for equal ones by row.
    ordered = keyed.repartitionByRange("doc_id", "begins", "row").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    made = ordered.mapInArrow(chunks, "part long, chunk long, start long, n long, doc_ids array<long>, lengths array<long>, payload binary")
    made.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The chunks below ``path`` with ``base``, the ids in all files before the one that holds them."""
    files = spark.read.parquet(path)
    # One row for each task that wrote, so one partition holds them.
    totals = files.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part")


def digest(chunks: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = memoryview(np.ascontiguousarray(expand(payload.as_py()), dtype="<u4")).cast("B")
                n = np.array(lengths.as_py(), dtype=np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.array(at + start.as_py()), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    of = chunks.select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload")
    return of.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path)
    return digest(read_ids(docs.sparkSession, path))
