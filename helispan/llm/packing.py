"""Packing by power-of-two decomposition: each piece is a sequence of its own, of a binary length.

A document's ids and its end id are cut into as many full sequences as fit and then into the binary
digits of the rest, largest first. Sequences of equal length form a bucket, none crosses documents,
and none needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches
from helispan.llm.tokens import BYTE_BPE, encoder

MAX_LENGTH = 1024
END_ID = 0
#: Rows of an output batch are cut at about so many bytes of ids.
BATCH_BYTES = 8 << 20


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: ``longest`` (a power of two) repeated, then falling powers of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str = BYTE_BPE, kind: str = "byte", end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids; ``length`` is the bucket. ``sequence_id`` is
    unique, and as each piece fills its sequence, ``offset`` is 0. A null or empty text is its end id
    alone; a null ``doc_id`` stays null; repeated rows are packed again; other columns are ignored.
    Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = encode(text) + end
                n, at = len(ids) // 4, 0
                for length in cuts(n, longest):
                    rows.append((doc, at, length, n, ids[4 * at : 4 * (at + length)]))
                    at += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences with a folder for each length, so that a batch can be read from one bucket."""
    packed.write.partitionBy("length").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
