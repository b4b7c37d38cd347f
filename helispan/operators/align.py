"""Alignment and matching of code matrices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helispan.functions.scalar import MISMATCH
from helispan.operators.pairs import against

#: Gap of the two levels for codes and for angles.
GAP_CODES, GAP_ANGLES = -1.0, -20.0
#: Codes of segment types, which stand on diagonals.
DIAGONAL_CODES = ["e ", "xa", "xi", "xg"]
#: Cells of the score tables that a task holds at once.
BUNDLE = 1 << 21
#: Tasks for each core in searches of all pairs.
TASKS = 4


def align_score(a: Column, b: Column, match: float = 1.0, mismatch: float = 0.0, gap: float = -1.0) -> Column:
    """Global alignment score of two arrays with free leading gaps (M1), as nested folds.

    The outer fold carries a row of the table; the inner one builds the next from it.
    """
    start = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: F.lit(0.0)))

    def row(above: Column, x: Column) -> Column:
        def cell(built: Column, y: Column) -> Column:
            j = F.size(built)
            diagonal = F.element_at(above, j) + F.when(x == y, F.lit(match)).otherwise(F.lit(mismatch))
            best = F.greatest(diagonal, F.element_at(above, j + 1) + gap, F.element_at(built, -1) + gap)
            return F.concat(built, F.array(best))

        return F.aggregate(b, F.array(F.lit(0.0)), cell)

    return F.element_at(F.aggregate(a, start, row), -1)


def align(score: np.ndarray, gap: float) -> tuple[float, list[tuple[int | None, int | None]]]:
    """Score and aligned places (M1-M3): diagonal first, then a gap in the first, then in the second sequence."""
    n, m = score.shape
    h = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i, j] = max(h[i - 1, j - 1] + score[i - 1, j - 1], h[i - 1, j] + gap, h[i, j - 1] + gap)
    path: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i and j:
        if abs(h[i, j] - h[i - 1, j - 1] - score[i - 1, j - 1]) < 1e-10:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif abs(h[i, j] - h[i, j - 1] - gap) < 1e-10:
            j -= 1
            path.append((None, j))
        else:
            i -= 1
            path.append((i, None))
    path += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return float(h[n, m]), path[::-1]


def alignment_strings(a: str, b: str, path: list[tuple[int | None, int | None]]) -> tuple[str, str]:
    """Both sequences with ``-`` in gaps and ``~`` before the first pair."""
    first = next((k for k, (i, j) in enumerate(path) if i is not None and j is not None), len(path))
    fill = lambda k: "~" if k < first else "-"
    return tuple("".join(s[x[side]] if x[side] is not None else fill(k) for k, x in enumerate(path)) for side, s in enumerate((a, b)))  # type: ignore[return-value]


def code_table(codes: list[str], typed: bool) -> np.ndarray:
    """Scores of each two of some codes; with ``typed``, segment types (the codes on diagonals) only match themselves."""
    first, other = np.array([c.ljust(2)[0] for c in codes]), np.array([c.ljust(2)[1] for c in codes])
    same = (first[:, None] == first).astype(int) + (other[:, None] == other)
    plain = np.array([-2.0, 1.0, 2.0])[same]
    if not typed:
        return plain
    diagonal = np.isin(codes, DIAGONAL_CODES)
    return np.where(diagonal[:, None] | diagonal, np.where(same == 2, 0.0, MISMATCH), plain)


def _angle_scores(a: np.ndarray, b: np.ndarray, typed: bool) -> np.ndarray:
    """Scores of angles in degrees; types are on the diagonals, which are carried apart from angles."""
    x, y = a[:, :, :, None, None], b[:, None, None, :, :]
    d = np.abs(np.degrees(x) - np.degrees(y))
    plain = 45.0 - np.minimum(d, 360.0 - d)
    if not typed:
        return plain
    da, db = np.eye(a.shape[1], dtype=bool)[:, :, None, None], np.eye(b.shape[1], dtype=bool)
    return np.where(da | db, np.where(da & db & (x == y), 0.0, MISMATCH), plain)


def place_scores(a: np.ndarray, b: np.ndarray, codes: list[str] | None, typed: bool) -> np.ndarray:
    """Scores (pair, i, k, j, l) of all places of the first matrices with all of the second ones.

    ``a`` and ``b`` hold a matrix for each pair, of angles or, where ``codes`` are given, of their numbers.
    """
    if codes is None:
        return _angle_scores(a, b, typed)
    return code_table(codes, typed)[a[:, :, :, None, None], b[:, None, None, :, :]]


def aligned(score: np.ndarray, gap: float) -> np.ndarray:
    """Scores of alignments (M1) for any number of tables at once; the last two axes are the two sequences."""
    n, m = score.shape[-2:]
    above = [np.zeros(score.shape[:-2])] * (m + 1)
    for i in range(n):
        row = [above[0]]
        for j in range(m):
            row.append(np.maximum(above[j] + score[..., i, j], np.maximum(above[j + 1], row[j]) + gap))
        above = row
    return above[m]


def match_places(scores: np.ndarray, gap: float) -> np.ndarray:
    """Two-level alignments (M4) of pairs of matrices: rows aligned pairwise give scores to align segments by."""
    return aligned(aligned(scores.transpose(0, 1, 3, 2, 4), gap), gap)


def match_matrices(a: np.ndarray, b: np.ndarray, gap: float | None = None, typed: bool = False) -> float:
    """Two-level alignment of two square matrices, of codes or of angles (M4)."""
    names = sorted({*a.ravel().tolist(), *b.ravel().tolist()}) if a.dtype.kind == "U" else None
    gap = (GAP_ANGLES if names is None else GAP_CODES) if gap is None else gap
    if not len(a) or not len(b):
        return 0.0
    one, two = (x if names is None else np.searchsorted(names, x) for x in (a, b))
    return float(match_places(place_scores(one[None], two[None], names, typed), gap)[0])


def order_of(size: int) -> int:
    """Rows of the square matrix whose triangle, packed, has so many places."""
    return (math.isqrt(8 * size + 1) - 1) // 2


def _squares(values: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrices from rows of packed triangles."""
    out = np.empty((len(values), n, n), values.dtype)
    j, i = np.tril_indices(n)
    out[:, i, j] = out[:, j, i] = values
    return out


def _grouped(one: pa.ListArray, two: pa.ListArray, bundle: int = BUNDLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str] | None]]:
    """Rows whose matrices have equal orders, in bundles of bounded size, with both matrices and the codes they number.

    Cells are taken out of the batch once; a null matrix is an empty one.
    """
    values, sizes, begins = [], [], []
    for column in (one, two):
        offsets = column.offsets.to_numpy().astype(np.int64)
        begins.append(offsets[:-1])
        sizes.append(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)))
        values.append(column.values)
    names = None
    if pa.types.is_string(values[0].type) or pa.types.is_large_string(values[0].type):
        found = pa.concat_arrays([v.cast(pa.string()) for v in values]).dictionary_encode()
        names, flat = found.dictionary.to_pylist(), found.indices.to_numpy()
        values = [flat[: len(values[0])], flat[len(values[0]) :]]
    else:
        values = [v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values]
    shape = sizes[0] << 32 | sizes[1]
    for xy in np.unique(shape).tolist():
        x, y = xy >> 32, xy & 0xFFFFFFFF
        rows = np.flatnonzero(shape == xy)
        n, m = order_of(x), order_of(y)
        step = max(1, bundle // max(1, (n * m) ** 2))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            matrices = [_squares(v[b[some][:, None] + np.arange(k)], order) for v, b, k, order in zip(values, begins, (x, y), (n, m), strict=True)]
            yield some, *matrices, names


def pairwise(database: DataFrame, queries: DataFrame, key: str, packed: str, compute: Callable[..., list[list]], fields: list[tuple[str, str, pa.DataType]], bundle: int = BUNDLE) -> DataFrame:
    """``query_id, key`` and the fields that ``compute`` finds, for every query's packed matrix with every matrix of a database.

    ``queries`` has query_id and packed, a stated set; they go to the tasks in blocks, and the database, which is small
    beside the pairs, is dealt to ``TASKS`` tasks for each core, whatever the number of its files. ``compute`` gets the matrices of many pairs of equal orders and the codes they number (none for
    angles), and returns a list of values for each field (name, SQL type, Arrow type). ``bundle`` bounds
    the places that the matrices given to it lay upon each other. A null matrix is an empty one.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), database.schema[key].dataType.simpleString()
    asked = queries.select("query_id", F.col(packed).alias("_query"))
    dealt = database.select(key, packed).repartition(TASKS * database.sparkSession.sparkContext.defaultParallelism)
    both = against(asked, dealt, "query_id").select("query_id", key, "_query", packed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[None] * batch.num_rows for _ in fields]
            for some, a, b, names in _grouped(batch.column(2), batch.column(3), bundle):
                for column, found in zip(out, compute(a, b, names), strict=True):
                    for k, value in zip(some.tolist(), found, strict=True):
                        column[k] = value
            values = [pa.array(c, t) for c, (_, _, t) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=["query_id", key, *[f[0] for f in fields]])

    return both.mapInArrow(rows, ", ".join([f"query_id {kinds[0]}", f"{key} {kinds[1]}", *[f"{name} {kind}" for name, kind, _ in fields]]))


def search(database: DataFrame, queries: DataFrame, key: str = "target_id", packed: str = "packed", typed: bool = False, gap: float | None = None) -> DataFrame:
    """``query_id, key, score`` of every query's packed matrix with every matrix of a database by two-level alignment."""

    def compute(a: np.ndarray, b: np.ndarray, names: list[str] | None) -> list[list]:
        if not a.shape[1] or not b.shape[1]:
            return [[0.0] * len(a)]
        own = (GAP_ANGLES if names is None else GAP_CODES) if gap is None else gap
        return [match_places(place_scores(a, b, names, typed), own).tolist()]

    return pairwise(database, queries, key, packed, compute, [("score", "double", pa.float64())])


def objective_terms(a: DataFrame, b: DataFrame, key: str, score: Column) -> DataFrame:
    """Coefficients of the matching problem (M8): one for each two places i, k of a matrix and j, l of another.

    ``a`` has key, i, k, code and ``b`` key, j, l, code2; ``score`` is of code and code2.
    """
    return a.join(b, key).select(key, "i", "j", "k", "l", (-score).alias("coefficient"))


def order_conflicts(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs of matches that cross and exclude each other (M9): i < k and l < j."""
    x = pairs.select(key, F.col("i"), F.col("j"))
    y = pairs.select(key, F.col("i").alias("k"), F.col("j").alias("l"))
    return x.join(y, key).where("i < k and l < j")


def match_constraints(matches: DataFrame, key: str, products: bool = True) -> DataFrame:
    """``key, constraint, variable, coefficient, bound`` of the matching problem (M9), each a sum that is at most its bound.

    ``matches`` has key, i, j: variable ``y_i_j`` says that i of one matrix is matched with j of the other.
    A row and a column match once; a variable ``x_i_j_k_l`` of two matches that do not cross is at most
    each of both, and, with ``products``, at least their sum less one; matches that cross exclude each other.
    """
    row = lambda constraint, variable, coefficient, bound: F.struct(constraint.alias("constraint"), variable.alias("variable"), F.lit(coefficient).alias("coefficient"), F.lit(bound).alias("bound"))
    y = F.concat_ws("_", F.lit("y"), "i", "j")
    one = matches.select(key, F.inline(F.array(row(F.concat_ws("_", F.lit("row"), "i"), y, 1, 1), row(F.concat_ws("_", F.lit("column"), "j"), y, 1, 1))))
    a, b = matches.select(key, "i", "j"), matches.select(key, F.col("i").alias("k"), F.col("j").alias("l"))
    # Each two matches are met once, and give all their rows there.
    two = a.join(b, key).where("i < k and j <> l").select(key, (F.col("j") < F.col("l")).alias("straight"), F.concat_ws("_", "i", "j", "k", "l").alias("four"), y.alias("y1"), F.concat_ws("_", F.lit("y"), "k", "l").alias("y2"))
    named = lambda name: F.concat(F.lit(f"{name}_"), "four")
    y1, y2, x = F.col("y1"), F.col("y2"), F.concat(F.lit("x_"), "four")
    first, second, both, cross = map(named, ("first", "second", "both", "cross"))
    kept = [row(first, x, 1, 0), row(first, y1, -1, 0), row(second, x, 1, 0), row(second, y2, -1, 0)]
    if products:
        kept += [row(both, y1, 1, 1), row(both, y2, 1, 1), row(both, x, -1, 1)]
    crossed = F.array(row(cross, y1, 1, 1), row(cross, y2, 1, 1))
    return one.unionByName(two.select(key, F.inline(F.when(F.col("straight"), F.array(*kept)).otherwise(crossed))))


def quadratic_terms(a: DataFrame, b: DataFrame, key: str, score: Column) -> DataFrame:
    """``key, p, q, value`` of the quadratic matching problem (M6): what it is worth to match i with j and k with l.

    ``a`` has key, n, i, k, code, kind, kind_k and ``b`` key, m, j, l, code2, kind2, kind2_l; p = i m + j and
    q = k m + l. Pairs of places in a different order, and matches of different kinds, are worth -999;
    cells of one row or column are left out.
    """
    d = a.join(b, key).where("i <> k and j <> l")
    bad = ((F.col("i") < F.col("k")) != (F.col("j") < F.col("l"))) | (F.col("kind") != F.col("kind2")) | (F.col("kind_k") != F.col("kind2_l"))
    return d.select(key, (F.col("i") * F.col("m") + F.col("j")).alias("p"), (F.col("k") * F.col("m") + F.col("l")).alias("q"), F.when(bad, F.lit(-999.0)).otherwise(score.cast("double")).alias("value"))
