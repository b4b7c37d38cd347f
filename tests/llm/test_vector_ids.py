"""The metric join with ids that are null or repeated, against brute force by rows."""

from __future__ import annotations

import math
import random

import pytest

from helispan.llm import lookup, vectors
from tests.llm import brute


def _plain(rows):
    """Rows of id, links, component and kept, where each row is a vector."""
    numbered = brute.vectors([(k, v) for k, (_, v) in enumerate(rows)])
    least: dict[int, int] = {}
    for k, (own, _) in enumerate(rows):
        if own is not None:
            least[numbered[k][1]] = min(least.get(numbered[k][1], own), own)
    out = []
    for k, (own, _) in enumerate(rows):
        component = least.get(numbered[k][1], own)
        out.append((own, numbered[k][0], component, own is not None and own == component))
    return sorted(out, key=repr)


def _at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def _rows():
    out = [(5, _at(0)), (None, _at(15)), (9, _at(30)), (None, _at(45)), (2, _at(100)), (2, _at(200)), (1, _at(110)), (4, _at(210)), (4, _at(211))]
    out += [(None, _at(300)), (None, _at(300)), (None, _at(310)), (7, _at(270)), (7, _at(270)), (8, None), (None, None), (None, [0.0, 0.0]), (3, [None, 1.0]), (6, [])]
    rng = random.Random(1)
    return out + [(rng.choice([None, *range(10, 40)]), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(150)]


@pytest.mark.parametrize(("root", "broadcast"), [(20, 200_000), (1, 0)])
def test_ids(spark, monkeypatch, root, broadcast):
    """One pivot, and many with replicas and joins by shuffles."""
    monkeypatch.setattr(vectors, "ROOT_PER_PIVOT", root)
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    rows = _rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.join(df).collect()), key=repr)
    assert got == _plain(rows)
    assert vectors.join(df.limit(0)).count() == 0
