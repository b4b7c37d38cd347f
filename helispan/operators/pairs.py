"""Pairs of one structure's segments: kernels, nearest neighbours, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)


def sides(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in by])


def triangular(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """All pairs of a structure's rows, the first before the second (J1); columns get ``a_`` and ``b_``.

    The structure is an equality, so the join is a hash or merge join within structures.
    """
    return sides(df, by, "a_").join(sides(df, by, "b_"), by).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


#: Queries that go to every task at once.
QUERIES = 20_000


def against(queries: DataFrame, rows: DataFrame, key: str, block: int = QUERIES) -> DataFrame:
    """Every row beside every one of a stated set of queries (J7), which go to the tasks in blocks of bounded size.

    Rows are read once for each block and not shuffled; ``key`` tells queries apart.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    if blocks == 1:
        return rows.join(F.broadcast(queries))
    parts = [queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(p)) for p in parts])


#: Vectors in a block of ``products``, and decimal places of its scores.
BLOCK, PLACES = 512, 9


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's vectors as rows, and their lengths: -1 for null vectors and those that hold a null."""
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy().astype(np.int64)))
    flat = column.flatten()
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    held = np.arange(out.shape[1]) < sizes[:, None]
    out[held] = numbers
    whole = np.array(~column.is_null().to_numpy(zero_copy_only=False))
    if flat.null_count:
        whole &= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) == 0
    return out, np.where(whole, sizes, -1)


def rounded(x: np.ndarray) -> np.ndarray:
    """Numbers rounded half up to ``PLACES``; those too great for that stay."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**PLACES
        whole = np.rint(scaled)
        half = np.abs(scaled - whole) == 0.5
        whole[half] = np.trunc(scaled[half]) + np.copysign(1.0, scaled[half])
        out = whole / 10.0**PLACES
    return out if np.isfinite(out).all() else np.where(np.isfinite(out), out, x)


def _in_order(a: np.ndarray, b: np.ndarray, there: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Sums of products along the last axis, from the first place on."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for k in range(a.shape[-1]):
        term = a[..., k] * b[..., k]
        total += term if there is None else np.where(there[0][..., k] & there[1][..., k], term, 0.0)
    return total


def rounded_products(a: np.ndarray, b: np.ndarray, there: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Products of all rows of two matrices, summed from the first place on and rounded half up to ``PLACES``.

    ``there`` says which places count; the others hold 0. A matrix product adds in another order: where that could change a rounded
    number, or one is not finite, the sum is taken again in order.
    """
    with np.errstate(all="ignore"):
        scaled = a @ b.T
        scaled *= 10.0**PLACES
        whole = np.rint(scaled)
        scaled -= whole
        np.abs(scaled, out=scaled)
        # Twice the bound of what two sums of the same terms differ by; not a number if a vector is not finite.
        longest = [np.sqrt(np.einsum("ij,ij->i", x, x)).max(initial=0.0) for x in (a, b)]
        slack = 4.0 * (a.shape[1] + 4) * np.finfo(float).eps * longest[0] * longest[1] * 10.0**PLACES
        i, j = np.nonzero(~(scaled < 0.5 - slack))
        whole /= 10.0**PLACES
        if len(i) > whole.size >> 3:
            for at in range(len(a)):
                whole[at] = rounded(_in_order(a[at], b, None if there is None else (there[0][at], there[1])))
        elif len(i):
            whole[i, j] = rounded(_in_order(a[i], b[j], None if there is None else (there[0][i], there[1][j])))
    return whole


def products(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, best: int | None = None) -> DataFrame:
    """``query_id, key, score, label``: rounded products of every query with every other row (J7), and whether their labels are equal.

    Both have the key, the vector and a whole number as label. Rows are put in blocks, those of the queries go to all tasks, and each two blocks are
    multiplied at once. With ``best``, a block's rows that cannot be among a query's best so many are left out. The score is
    null for vectors that are null, hold a null or are of different lengths.
    """
    kind = rows.schema[key].dataType.simpleString()
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism

    def blocks(of: DataFrame) -> DataFrame:
        columns = [F.col(key).cast("long"), F.col(vector).cast("array<double>"), F.col(label).cast("long")]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], names=["k", "v", "l"])

        return of.select(*[c.alias(n) for n, c in zip("kvl", columns, strict=True)]).mapInArrow(cut, "k array<bigint>, v array<array<double>>, l array<bigint>")

    asked = queries.repartition(1 + queries.count() // (8 * BLOCK))
    dealt = blocks(rows.repartition(tasks))
    both = dealt.join(F.broadcast(blocks(asked).select(F.col("k").alias("qk"), F.col("v").alias("qv"), F.col("l").alias("ql"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                k, v, own, qk, qv, asked_for = (batch.column(c)[r].values for c in range(6))
                (a, n), (b, m) = _vectors(v), _vectors(qv)
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
                found = rounded_products(b, a)
                none = (m[:, None] != n) | (m[:, None] < 0)
                keys, names = k.to_numpy(), qk.to_numpy()
                kept = names[:, None] != keys
                if best is not None and len(keys) > best:
                    seen = np.where(kept & ~none & ~np.isnan(found), found, -np.inf)
                    least = np.partition(seen, len(keys) - best, axis=1)[:, len(keys) - best]
                    kept &= (found >= least[:, None]) | none | np.isnan(found)
                i, j = np.nonzero(kept)
                ((x, no_x), (y, no_y)) = ((c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False)) for c in (own, asked_for))
                same = pa.array((x[j] == y[i]).astype(np.int32), mask=no_x[j] | no_y[i])
                out = [pa.array(names[i]), pa.array(keys[j]), pa.array(found[i, j], mask=none[i, j]), same]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", key, "score", "label"])

    scored = both.select("k", "v", "l", "qk", "qv", "ql").mapInArrow(score, f"query_id bigint, {key} bigint, score double, label int")
    return scored.select(F.col("query_id").cast(kind).alias("query_id"), F.col(key).cast(kind).alias(key), "score", "label")


def nearest(df: DataFrame, by: list[str], key: str, dist: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """Each row's nearest other row of its structure, the one of the least key among equals (T4)."""
    pairs = sides(df, by, "a_").join(sides(df, by, "b_"), by).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    d = dist(F.col(f"a_{value}"), F.col(f"b_{value}"))
    best = F.min(F.struct(d.alias("dist"), F.col(f"b_{key}").alias("nearest")))
    return pairs.groupBy(*by, F.col(f"a_{key}").alias(key)).agg(best.alias("_b")).select(*by, key, "_b.nearest", "_b.dist")


def nearest_between(df: DataFrame, by: list[str], key: str, first: Column, dist: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """The nearest pair between the rows where ``first`` holds and the others, for each structure."""
    a, b = sides(df.where(first), by, "a_"), sides(df.where(~first), by, "b_")
    d = dist(F.col(f"a_{value}"), F.col(f"b_{value}"))
    best = F.min(F.struct(d.alias("dist"), F.col(f"a_{key}").alias("src"), F.col(f"b_{key}").alias("dst")))
    return a.join(b, by).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.src", "_b.dst", "_b.dist")


def within(df: DataFrame, by: list[str], key: str, dist: Callable[[Column, Column], Column], value: str, limit: float) -> DataFrame:
    """Edges between rows closer than ``limit``."""
    d = dist(F.col(f"a_{value}"), F.col(f"b_{value}"))
    pairs = triangular(df.select(*by, key, value), by, key).withColumn("dist", d)
    return pairs.where(F.col("dist") < limit).select(*by, F.col(f"a_{key}").alias("src"), F.col(f"b_{key}").alias("dst"), "dist")


def near_set(df: DataFrame, by: list[str], key: str, chosen: Column, dist: Callable[[Column, Column], Column], value: str, limit: float) -> DataFrame:
    """Rows closer than ``limit`` to some chosen row, with the least distance."""
    a, b = sides(df.where(chosen), by, "a_"), sides(df.where(~chosen), by, "b_")
    d = a.join(b, by).withColumn("dist", dist(F.col(f"a_{value}"), F.col(f"b_{value}"))).where(F.col("dist") < limit)
    return d.groupBy(*by, F.col(f"b_{key}").alias(key)).agg(F.min("dist").alias("dist"))


def pack(pairs: DataFrame, by: list[str], i: str, j: str, value: str) -> DataFrame:
    """A structure's upper triangle as one array in packed order."""
    rows = F.sort_array(F.collect_list(F.struct(j, i, value)))
    return pairs.groupBy(*by).agg(F.transform(rows, lambda x: x[value]).alias("packed"))


def unpack(packed: DataFrame, by: list[str]) -> DataFrame:
    """The inverse of ``pack``: by, i, j, value with 0-based i <= j."""
    d = packed.select(*by, F.posexplode("packed").alias("r", "value"))
    j = F.floor((F.sqrt(8.0 * F.col("r") + 1) - 1) / 2).cast("long")
    return d.select(*by, (F.col("r") - (j * (j + 1) / 2).cast("long")).alias("i"), j.alias("j"), "value")
