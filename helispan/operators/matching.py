"""Matching of the segments of two structures by their matrices: exactly (M10) and by relaxation (M6, M7).

A matching is a set of pairs (i, j), each row i of one matrix and each column j of the other at most once. It is worth
the scores of all places that it lays upon each other, [i, k] on [j, l] for each two of its pairs.
The original formats left both problems to external solvers; the searches here are of the library's own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helispan.operators.align import BUNDLE, code_table, pairwise, place_scores

#: What a place is worth whose pairs are of different types or out of order, in the relaxed problem.
PENALTY = -999.0
#: Steps, first and last sharpness of the relaxation, and rounds in which rows and columns are evened out.
STEPS, SHARPNESS, EVEN = 40, (0.2, 20.0), 12
#: Single pairs that the improvement starts from besides.
SEEDS = 24
#: Matchings that are valued one and all, instead of by branch and bound.
LISTED = 2_000
#: Matchings without crossings that are valued one and all instead of a relaxation, and pairs of matrices for which that is done at once.
COUNTED, TOGETHER = 20_000, 10_240


def best_matching(w: np.ndarray, ordered: bool = True, products: bool = True) -> tuple[float, list[tuple[int, int]]]:
    """The matching worth most under ``w[i, j, k, l]``, and its pairs, by branch and bound.

    ``ordered`` forbids pairs that cross. With ``products`` a place counts whenever both its pairs are matched; without,
    a place that lowers the value may be left out, as the constraints then let its variable be 0. Among equal
    matchings it is the first one, where a row's lesser columns come before its greater ones and none comes last.

    Rows are decided one after another. The bound of a beginning adds for each later row the best column's own worth, its worth with
    the pairs chosen, and for each undecided row before it the greatest worth that a pair of that row can bring it.
    """
    m, n = w.shape[:2]
    if not products:
        w = np.maximum(w, 0.0)
    both = w + w.transpose(2, 3, 0, 1)
    own = np.einsum("ijij->ij", w)
    columns = np.arange(n)
    fits = columns[:, None] < columns if ordered else columns[:, None] != columns
    # Over the pairs (i, j) of each row i that fit with (k, l).
    brings = np.where(fits[None, :, None, :], both, 0.0).max(axis=1, initial=0.0)
    later = np.arange(m)[:, None] < np.arange(m)
    brings *= later[:, :, None]
    hope = np.zeros((m + 1, m, n))
    for i in range(m - 1, -1, -1):
        hope[i] = hope[i + 1] + brings[i]
    best, chosen = 0.0, None
    taken: list[tuple[int, int]] = []

    def decide(row: int, value: float, worth: np.ndarray, free: np.ndarray) -> None:
        nonlocal best, chosen
        if chosen is None or value > best:
            # A beginning is a matching too; equal ones that go on come first, and are met before rows are left out.
            if row == m:
                best, chosen = value, list(taken)
                return
        if row == m:
            return
        rest = np.where(free, own[row:] + worth[row:] + hope[row, row:], 0.0).max(axis=1, initial=0.0)
        if chosen is not None and value + rest.sum() <= best + 1e-9:
            return
        for j in np.flatnonzero(free).tolist():
            taken.append((row, j))
            decide(row + 1, value + own[row, j] + worth[row, j], worth + both[row, j], free & fits[j])
            taken.pop()
        decide(row + 1, value, worth, free)

    decide(0, 0.0, np.zeros((m, n)), np.ones(n, bool))
    return best, chosen or []


def _countable(m: int, n: int, ordered: bool) -> bool:
    """Whether m rows and n columns have ``LISTED`` matchings at most."""
    fewer, more = min(m, n), max(m, n)
    return (math.comb(m + n, m) if ordered else sum(math.comb(fewer, k) * math.perm(more, k) for k in range(fewer + 1))) <= LISTED


def best_matchings(w: np.ndarray, ordered: bool = True, products: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """``best_matching`` of many problems (pair, i, j, k, l) at once: those of few matchings are all valued, for all problems together.

    Matchings are built up row by row in the order that decides among equals; what a pair adds is a sum of a few
    cells, each a vector over the problems.
    """
    pairs, m, n = w.shape[:3]
    if not _countable(m, n, ordered):
        found = [best_matching(x, ordered, products) for x in w]
        return np.array([value for value, _ in found]), [own for _, own in found]
    if not products:
        w = np.maximum(w, 0.0)
    cells = np.ascontiguousarray(w.transpose(1, 2, 3, 4, 0))
    both = cells + cells.transpose(2, 3, 0, 1, 4)
    best, at, listed = np.full(pairs, -np.inf), np.zeros(pairs, np.int64), []
    taken: list[tuple[int, int]] = []

    def decide(row: int, value: np.ndarray) -> None:
        nonlocal best
        if row == m:
            at[value > best + 1e-9] = len(listed)
            best = np.maximum(best, value)
            listed.append(list(taken))
            return
        for j in range(n):
            if all(x < j if ordered else x != j for _, x in taken):
                worth = value + cells[row, j, row, j]
                for k, x in taken:
                    worth += both[k, x, row, j]
                taken.append((row, j))
                decide(row + 1, worth)
                taken.pop()
        decide(row + 1, value)

    decide(0, np.zeros(pairs))
    return best, [listed[k] for k in at.tolist()]


def quadratic_forms(scores: np.ndarray, types_a: np.ndarray, types_b: np.ndarray, typed: bool, ordered: bool) -> np.ndarray:
    """The problems (M6) of many pairs of matrices as symmetric forms over (i, j): pair, i, j, k, l.

    ``scores`` is (pair, i, k, j, l). Places of one row or column are worth nothing, those with unlike types or out
    of order PENALTY.
    """
    q = scores.transpose(0, 1, 3, 2, 4).copy()
    m, n = q.shape[1:3]
    rows, columns = np.arange(m), np.arange(n)
    if ordered:
        turned = np.sign(rows[:, None] - rows)[:, None, :, None] * np.sign(columns[:, None] - columns)[None, :, None, :] < 0
        q[:, turned] = PENALTY
    if typed:
        unlike = types_a[:, :, None] != types_b[:, None, :]
        q = np.where(unlike[:, :, :, None, None] | unlike[:, None, None, :, :], PENALTY, q)
    q[:, rows, :, rows, :] = 0.0
    q[:, :, columns, :, columns] = 0.0
    return (q + q.transpose(0, 3, 4, 1, 2)) / 2


def relax(q: np.ndarray) -> np.ndarray:
    """Doubly substochastic matrices (pair, i, j) that the forms grow towards, by graduated assignment.

    Each step takes exponentials of the form's gradient at growing sharpness, and evens out rows and columns, beside a slack row
    and column, so that their sums are at most 1.
    """
    pairs, m, n = q.shape[:3]
    flat = q.reshape(pairs, m * n, m * n)
    usual = np.where(flat > PENALTY / 4, np.abs(flat), 0.0).max(axis=(1, 2), initial=0.0)
    usual = np.where(usual > 0, usual, 1.0)
    # A penalty need only outweigh what a pair can bring.
    mild = np.maximum(flat, -2.0 * usual[:, None, None] * min(m, n)) / usual[:, None, None]
    # A slight slope tells equal matchings apart.
    x = (1.0 / (max(m, n) + 1)) * (1.0 - 1e-3 * np.arange(m * n) / (m * n)) * np.ones((pairs, 1))
    for sharp in np.geomspace(*SHARPNESS, STEPS):
        slope = np.einsum("pij,pj->pi", mild, x)
        top = np.maximum(slope.max(axis=1), 0.0)
        z = np.zeros((pairs, m + 1, n + 1))
        z[:, :m, :n] = np.exp(sharp * (slope - top[:, None])).reshape(pairs, m, n)
        slack = np.exp(-sharp * top)
        z[:, m, :], z[:, :, n] = slack[:, None], slack[:, None]
        z[:, m, n] = 0.0
        z = np.maximum(z, 1e-300)
        for _ in range(EVEN):
            z[:, :m] /= z[:, :m].sum(axis=2, keepdims=True)
            z[:, :, :n] /= z[:, :, :n].sum(axis=1, keepdims=True)
        # Columns sum to 1 with slack, rows may exceed it a little.
        x = (z[:, :m, :n] / np.maximum(1.0, z[:, :m, :n].sum(axis=2, keepdims=True))).reshape(pairs, m * n)
    return x.reshape(pairs, m, n)


def _rounded(x: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Matchings by taking the greatest cells first."""
    left = x.copy()
    pairs, m, n = x.shape
    out = np.zeros(x.shape, bool)
    every = np.arange(pairs)
    for _ in range(min(m, n)):
        at = left.reshape(pairs, -1).argmax(axis=1)
        i, j = at // n, at % n
        out[every, i, j] |= left[every, i, j] > least
        left[every, i, :] = 0.0
        left[every, :, j] = 0.0
    return out


def improve(q: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and matchings that no change of one pair betters: a pair is taken out, or one is put in for those in its row and column."""
    pairs, m, n = matched.shape
    flat, y = q.reshape(pairs, m * n, m * n), matched.reshape(pairs, m * n).copy()
    cells = np.arange(m * n)
    row_of, column_of = cells // n, cells % n
    g = np.einsum("pij,pj->pi", flat, y.astype(float))
    left = np.arange(pairs)
    # What no change betters is put aside; the others' slopes follow the cells that change.
    for _ in range(4 * m * n):
        own, slope = y[left], g[left]
        grid = own.reshape(len(left), m, n)
        in_row = np.where(grid.any(axis=2), np.arange(m) * n + grid.argmax(axis=2), -1)[:, row_of]
        in_column = np.where(grid.any(axis=1), grid.argmax(axis=1) * n + np.arange(n), -1)[:, column_of]
        every = np.arange(len(left))[:, None]
        lost_row = np.where(in_row >= 0, slope[every, in_row], 0.0)
        lost_column = np.where(in_column >= 0, slope[every, in_column], 0.0)
        shared = np.where((in_row >= 0) & (in_column >= 0), flat[left[:, None], in_row, in_column], 0.0)
        gain = np.where(own, -slope, slope - lost_row - lost_column + shared)
        at = gain.argmax(axis=1)
        rows = np.flatnonzero(gain[np.arange(len(left)), at] > 1e-9)
        if not len(rows):
            break
        cell, left = at[rows], left[rows]
        present = own[rows, cell]
        for other in (in_row[rows, cell], in_column[rows, cell]):
            some = np.flatnonzero((other >= 0) & ~present)
            out = some[y[left[some], other[some]]]
            y[left[out], other[out]] = False
            g[left[out]] -= flat[left[out], other[out]]
        y[left, cell] = ~present
        g[left] += np.where(present, -1.0, 1.0)[:, None] * flat[left, cell]
    value = np.einsum("pi,pi->p", y.astype(float), np.einsum("pij,pj->pi", flat, y.astype(float))) / 2
    return value, y.reshape(pairs, m, n)


def relaxed_matchings(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and matchings found for the forms by relaxation, rounding and improvement, the best of several starts.

    The starts are the rounded relaxation, cells by their greatest worths, and single pairs, those of the relaxation's greatest cells.

    It is not the interior-point search that the matcher once called, and finds another local optimum where there
    are several; on small matrices tests hold its values against all matchings.
    """
    x = relax(q)
    pairs, m, n = x.shape
    starts = [_rounded(x), _rounded(np.maximum(np.where(q > PENALTY / 4, q, 0.0).max(axis=(3, 4)), 0.0))]
    for at in np.argsort(-x.reshape(pairs, -1), axis=1, kind="stable")[:, :SEEDS].T:
        seed = np.zeros((pairs, m * n), bool)
        seed[np.arange(pairs), at] = True
        starts.append(seed.reshape(pairs, m, n))
    best, matched = improve(q, starts[0])
    for start in starts[1:]:
        value, found = improve(q, start)
        more = value > best + 1e-9
        best, matched = np.where(more, value, best), np.where(more[:, None, None], found, matched)
    return best, matched


def ordered_matchings(a: np.ndarray, b: np.ndarray, names: list[str] | None, typed: bool, listed: bool) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The greatest values of the problems of ``quadratic_forms`` with ``ordered``, and with ``listed`` the first matchings that have them: all matchings are valued, for all pairs of symmetric matrices together.

    A matching is built up by its pairs, and for all that may follow them it is known what these would gain. Pairs of unlike types are worth PENALTY on their own, so that no matching with one is better than none.
    Codes score small whole numbers, of which 16 bits hold the sums: more than eight pairs make more than ``COUNTED`` matchings.
    """
    count, m, n = len(a), a.shape[1], b.shape[1]
    kind = np.dtype(float if names is None else np.int16)
    table = None if names is None else code_table(names, False).astype(kind).ravel()
    unlike = np.diagonal(a, axis1=1, axis2=2).T[:, None] != np.diagonal(b, axis1=1, axis2=2).T
    # Places of both matrices as rows over the pairs; those of the first are rows of the table of scores.
    a, b = (np.ascontiguousarray(x.transpose(1, 2, 0) * by) for x, by in ((a, 1 if names is None else len(names)), (b, 1)))

    def after(i: int, j: int) -> np.ndarray:
        """What the pair (i, j) adds to each pair of a later row and a later column."""
        x, y = a[i, i + 1 :, None], b[j, None, j + 1 :]
        if table is not None:
            return table.take(x + y, mode="clip")
        d = np.abs(np.degrees(x) - np.degrees(y))
        return 45.0 - np.minimum(d, 360.0 - d)

    adds = {(i, j): after(i, j) for i in range(m - 1) for j in range(n - 1)}
    own = np.zeros((m, n, count), kind)
    if typed:
        own[unlike] = PENALTY
    best, at = np.full(count, -1, kind), np.full(count, -1)
    found: list[list[tuple[int, int]]] = []
    room = [np.empty((m - k) * (n - k) * count, kind) for k in range(min(m, n))]

    def decide(row: int, column: int, value: np.ndarray, gain: np.ndarray, taken: list[tuple[int, int]]) -> None:
        """Matchings that go on from ``taken`` with the rows and columns of ``gain``, which start at ``row`` and ``column``."""
        rows, columns = gain.shape[:2]
        worth = gain.reshape(rows * columns, count)
        most = worth.max(axis=0) + value
        if listed:
            more = np.flatnonzero(most > best)
            at[more] = len(found) + worth[:, more].argmax(axis=0)
            found.extend([*taken, (row + i, column + j)] for i in range(rows) for j in range(columns))
        np.maximum(best, most, out=best)
        for i in range(rows - 1):
            for j in range(columns - 1):
                left = (rows - i - 1, columns - j - 1, count)
                further = room[len(taken) + 1][: math.prod(left)].reshape(left)
                np.add(gain[i + 1 :, j + 1 :], adds[row + i, column + j], out=further)
                decide(row + i + 1, column + j + 1, value + gain[i, j], further, [*taken, (row + i, column + j)])

    decide(0, 0, np.zeros(count, kind), own, [])
    # It refers to itself, which would keep all arrays until cycles are collected.
    del decide
    return np.maximum(best, 0).astype(float), [found[k] if k >= 0 else [] for k in at.tolist()] if listed else []


_MATCHES = ("matches", "array<struct<i:int,j:int>>", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))


def _listed(matched: np.ndarray) -> list[list[dict[str, int]]]:
    return [[{"i": i, "j": j} for i, j in np.argwhere(y).tolist()] for y in matched]


def search_exact(database: DataFrame, queries: DataFrame, key: str = "target_id", packed: str = "packed", ordered: bool = True, products: bool = True) -> DataFrame:
    """``query_id, key, objective, matches`` of every query's packed matrix of codes with every matrix of a database.

    The objective is minimised, as the solvers' formats have it: it is less the value of the best matching. Empty and null
    matrices match nothing, at 0. Work grows exponentially at worst, so matrices should be small; pairs are dealt to all tasks.
    """

    def compute(a: np.ndarray, b: np.ndarray, names: list[str] | None) -> list[list]:
        if not a.shape[1] or not b.shape[1]:
            return [[0.0] * len(a), [[]] * len(a)]
        values, listed = [], []
        step = max(1, (BUNDLE >> 3) // (a.shape[1] * b.shape[1]) ** 2)
        for at in range(0, len(a), step):
            scores = place_scores(a[at : at + step], b[at : at + step], names, False)
            value, pairs = best_matchings(scores.transpose(0, 1, 3, 2, 4), ordered, products)
            values += (-value + 0.0).tolist()
            listed += [[{"i": i, "j": j} for i, j in own] for own in pairs]
        return [values, listed]

    return pairwise(database, queries, key, packed, compute, [("objective", "double", pa.float64()), _MATCHES])


def search_relaxed(
    database: DataFrame, queries: DataFrame, key: str = "target_id", packed: str = "packed", typed: bool = True, ordered: bool = True, listed: bool = True
) -> DataFrame:
    """``query_id, key, objective, matches`` of every query's packed matrix with every matrix of a database (M6, M7, J7), without matches unless ``listed``.

    The objective is minimised: half the negative quadratic form, that is the negative scores of all places off
    the diagonals, once for each two pairs. Empty and null matrices match nothing, at 0. Where at most ``COUNTED`` matchings do not cross, as of
    eight by eight, the best of all is found (``ordered_matchings``); other problems are solved by relaxation.
    """

    def compute(a: np.ndarray, b: np.ndarray, names: list[str] | None) -> list[list]:
        m, n = a.shape[1], b.shape[1]
        if not m or not n:
            return [[0.0] * len(a), [[]] * len(a)][: 1 + listed]
        kinds = [np.diagonal(x, axis1=1, axis2=2) for x in (a, b)]
        counted = ordered and math.comb(m + n, m) <= COUNTED
        values, matches = [], []
        step = (TOGETHER if names is not None else TOGETHER >> 2) if counted else max(1, BUNDLE // (8 * (m * n) ** 2))
        for at in range(0, len(a), step):
            one, two = a[at : at + step], b[at : at + step]
            if counted:
                best, found = ordered_matchings(one, two, names, typed, listed)
                matches += [[{"i": i, "j": j} for i, j in own] for own in found]
            else:
                scores = place_scores(one, two, names, False)
                best, matched = relaxed_matchings(quadratic_forms(scores, kinds[0][at : at + step], kinds[1][at : at + step], typed, ordered))
                matches += _listed(matched) if listed else []
            values += (-best + 0.0).tolist()
        return [values, matches][: 1 + listed]

    return pairwise(database, queries, key, packed, compute, [("objective", "double", pa.float64()), _MATCHES][: 1 + listed], TOGETHER << 12)
