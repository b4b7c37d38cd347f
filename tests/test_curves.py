"""Curves of searches: odd vectors against the SQL, and plans that neither shuffle nor write hits."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helispan.operators import curves, pairs
from helispan.plans import bindings
from tests.oracle import SF_DIR, compare


def _table(sf_dir, rows):
    ids, vectors, labels = zip(*rows, strict=True)
    made = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    pq.write_table(pa.table(made), sf_dir / "embeddings.parquet", row_group_size=50)
    return str(sf_dir)


def _same(spark, name, sf_dir):
    """Every cell as the SQL has it, to the last bit."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    wanted = c.execute(bindings.oracle_sql()[name])
    names = sorted(d[0] for d in wanted.description)
    places = [[d[0] for d in wanted.description].index(n) for n in names]
    plain = lambda x: "nan" if isinstance(x, float) and np.isnan(x) else x if not isinstance(x, float) else x + 0.0
    rows = sorted((tuple(plain(r[k]) for k in places) for r in wanted.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in bindings.queries()[name](spark, sf_dir).collect()), key=repr)
    assert got == rows
    return len(got)


def _odd():
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], k % 3) for k in range(1, 260)]
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 4, 0), (303, [1.0, None, 0.5, None], 1), (304, [1.0, 2.0], 0), (305, [1.0] * 6, 1)]
    rows += [(306, [float("inf"), 1.0, 0.0, 0.0], 1), (307, [float("nan"), 1.0, 1.0, 1.0], 0), (308, [1e30, -1e30, 1e30, 1.0], 1), (309, [1.0] * 4, None)]
    rows += [(400, [1.0, None, 0.5, 0.1], 0), (500, [0.1, 0.2], 1), (600, [0.3] * 4, None), (700, [float("inf"), 1.0, 1.0, 1.0], 9), (-100, [0.7, 0.1, 0.2, 0.3], 2), (None, [1.0] * 4, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", ["roc_curve_points", "roc_auc"])
def test_odd_vectors(spark, tmp_path, name):
    """Nulls, other lengths, ties and numbers that are not finite; scores of no place come last."""
    assert _same(spark, name, _table(tmp_path, _odd())) > 5


@pytest.mark.parametrize("name", ["roc_curve_points", "roc_auc"])
def test_repeated_ids(spark, tmp_path, name):
    """Hits of several queries of one id are one curve; rows given twice are alike, so that no order is left open."""
    rows = [(k, [float(k % 7), 1.0], k % 2) for k in range(95, 205)] + [(100, [2.5, 0.5], 0), (120, [1.0, 1.0], 0), (120, [1.0, 1.0], 0)]
    assert _same(spark, name, _table(tmp_path, rows)) >= 2


def _ranked(rows):
    """What a task finds that has all queries."""
    rows = [r for r in rows if r[0] is not None]

    def packed(some, together):
        kinds = (pa.int64(), pa.list_(pa.float32()), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
        batch = pa.RecordBatch.from_arrays(columns, names=["k", "v", "l"])
        return list(curves._pack(iter([batch.slice(0, 30), batch.slice(30)]), together))

    (asked,) = packed([r for r in rows if r[0] % 100 == 0], True)
    both = [pa.RecordBatch.from_arrays([*b.columns, *asked.columns], names=[*b.schema.names, *["q" + n for n in asked.schema.names]]) for b in packed(rows, False)]
    return len(both), sorted((repr([None if x is None else x.tolist() for x in found]) for found in curves._ranked(iter(both))))


def test_in_parts(monkeypatch):
    """Blocks of few vectors, most of them in a file, and one query at a time give what all at once give."""
    rows = _odd() + [(100, [2.5, 0.5], 0), (120, [1.0, 1.0], 0)]
    blocks, whole = _ranked(rows)
    for limit, value in (("BLOCK", 40), ("VECTORS", 1000), ("SCORES", 1)):
        monkeypatch.setattr(curves, limit, value)
    more, parts = _ranked(rows)
    assert more > 3 * blocks and parts == whole and len(whole) == 8


@pytest.mark.parametrize("name", ["roc_curve_points", "roc_auc"])
def test_hits_are_not_shuffled(spark, name):
    """All pairs were sorted by ranges and written; only the queries are dealt now."""
    plan = bindings.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "CartesianProduct" in plan and "ranges-" not in plan
    assert compare(bindings.queries()[name](spark, SF_DIR), bindings.oracle_sql()[name]) > 0


def test_rounded_products_are_summed_in_order():
    """Sums that another order would round otherwise, and numbers that are not finite."""
    rng = np.random.default_rng(2)
    for scale in (1.0, 1e-9, 1e5, 1e160):
        a, b = rng.normal(size=(7, 40)) * scale, rng.normal(size=(900, 40))
        b[::50, 3], b[1::50] = np.inf, np.round(b[1::50], 1)
        a[2] = np.round(a[2] / scale, 1) + 5e-10
        total = np.zeros((7, 900))
        for x, y in zip(a.T, b.T, strict=True):
            total += x[:, None] * y
        assert np.array_equal(pairs.rounded_products(a, b), pairs.rounded(total), equal_nan=True)
    assert pairs.rounded(np.array([0.5e-9, -0.5e-9, 1e305, 1.4e-9])).tolist() == [1e-9, -1e-9, 1e305, 1e-9]


def test_order():
    rng = np.random.default_rng(1)
    for scores in (rng.integers(-5, 5, 400) / 1e9, rng.normal(size=400) * 1e12, np.array([np.nan, 1.0, np.inf, -np.inf, np.nan]), np.zeros(0)):
        assert curves._order(scores, None).tolist() == np.argsort(scores, kind="stable").tolist()
    assert curves._order(np.array([2.0, 0.0, np.nan, 1.0, 0.0]), np.array([False, True, False, False, True])).tolist() == [3, 0, 2, 1, 4]
