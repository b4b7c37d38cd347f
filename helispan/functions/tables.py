"""Table functions for SQL: constraints of the matching problem and the path of an alignment (M2, M9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from helispan.operators.align import align


@udtf(returnType="constraint string, variable string, coefficient int, bound int")
class MatchConstraints:
    """``match_constraints(m, n, products)``: the constraints for matching m segments with n, each a sum that is at most its bound (M9).

    The rows are those of ``align.match_constraints`` for all m n matches; null or negative orders have none.
    """

    def eval(self, m: int, n: int, products: bool) -> Iterator[tuple]:
        rows, columns = range(m or 0), range(n or 0)
        for i in rows:
            for j in columns:
                yield f"row_{i}", f"y_{i}_{j}", 1, 1
                yield f"column_{j}", f"y_{i}_{j}", 1, 1
        for i in rows:
            for k in range(i + 1, m):
                for j in columns:
                    for l in columns:
                        if j == l:
                            continue
                        name, one, two = f"{i}_{j}_{k}_{l}", f"y_{i}_{j}", f"y_{k}_{l}"
                        sums = [("cross", 1, [(one, 1), (two, 1)])]
                        if j < l:
                            sums = [("first", 0, [(f"x_{name}", 1), (one, -1)]), ("second", 0, [(f"x_{name}", 1), (two, -1)])]
                            sums += [("both", 1, [(one, 1), (two, 1), (f"x_{name}", -1)])] if products else []
                        for kind, bound, terms in sums:
                            for variable, coefficient in terms:
                                yield f"{kind}_{name}", variable, coefficient, bound


@udtf(returnType="step int, i int, j int, score double")
class AlignmentPath:
    """``alignment_path(a, b, gap)``: the aligned places of two arrays of strings, null in gaps, and the whole score in each row (M2).

    Equal items are worth 1. Null arrays are empty; two empty ones have no row.
    """

    def eval(self, a: list, b: list, gap: float) -> Iterator[tuple]:
        a, b = a or [], b or []
        score = np.array([[float(x == y) for y in b] for x in a]).reshape(len(a), len(b))
        value, path = align(score, float(gap))
        for step, (i, j) in enumerate(path):
            yield step, i, j, float(value)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL, for ``SELECT ... FROM t, LATERAL match_constraints(t.m, t.n, true)``."""
    spark.udtf.register("match_constraints", MatchConstraints)
    spark.udtf.register("alignment_path", AlignmentPath)
