"""Bounds of the batches that Python functions get."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most, so that long texts do not add up in a worker or its executor.
MAX_ROWS, MAX_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to these, where they are higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", MAX_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", MAX_BYTES)):
        now = spark.conf.get(key).lower()
        size = int(now.rstrip("b")) if now.rstrip("b").lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def runs(batches: Iterable[pa.RecordBatch], *keys: int) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal integers in the columns ``keys``, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    of: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if key != of and held:
                yield _whole(held)
                held = []
            of = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def bundles(rows: Iterable, size: int) -> Iterator[list]:
    """Successive lists of ``size`` of the rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def batch_of(rows: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A batch of rows given as sequences of cells."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[name for name, _ in kinds])
