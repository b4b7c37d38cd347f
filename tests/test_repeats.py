"""Files whose numbers, cards or names repeat, as larger tables have them."""

import os
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helispan.operators import align, pairs
from helispan.plans import bindings
from tests.oracle import SF_DIR, TABLES, compare


@pytest.fixture
def tables(tmp_path):
    """A folder of the small tables in which some are replaced."""

    def make(**replaced: dict):
        for name in TABLES:
            at = tmp_path / f"{name}.parquet"
            if name in replaced:
                pq.write_table(pa.table(replaced[name]), at)
            else:
                os.symlink(Path(SF_DIR, at.name), at)
        return str(tmp_path)

    return make


def _orders(keys: list[int]) -> dict:
    return {"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array([1] * len(keys), pa.int64()), "o_totalprice": pa.array([1.0] * len(keys))}


def _same(spark, name: str, sf_dir: str) -> int:
    return compare(bindings.queries()[name](spark, sf_dir), bindings.oracle_sql()[name], sf_dir)


def test_clusters_of_one_number_in_a_file_are_two(spark, tables):
    # 11742 begins with no protein, 10742 with one; both are cluster 742.
    assert _same(spark, "protein_clusters", tables(orders=_orders([10742, 11742]))) == 3


@pytest.mark.parametrize("name", ["card_segments", "card_bridges"])
def test_cards_alike_and_keys_of_any_size(spark, tables, name):
    # 15001 and 30001 make the same strand of one chain; greater keys than a billion come before the first atom too.
    assert _same(spark, name, tables(orders=_orders([1, 15001, 30001, 2, 3, 5, 1_000_000_013, 3_000_000_002, 3_000_000_005]))) > 0


def test_blocks_of_domains_with_keys_of_any_size(spark, tables):
    assert _same(spark, "ddomain_segments", tables(orders=_orders([0, 1, 7, 2_000_000_000, 7_000_000_007]))) > 0


def test_joined_databases_with_keys_of_seven_digits(spark, tables):
    lines = {"l_orderkey": [0, 1, 1, 1234567, 1234567, 12345678], "l_linenumber": [1, 1, 2, 1, 2, 1], "l_partkey": [1, 2, 3, 4, 5, 6], "l_suppkey": [1, 2, 3, 4, 5, 6]}
    made = {c: pa.array(v, pa.int64()) for c, v in lines.items()} | {"l_quantity": pa.array([1.0, 2, 3, 4, 5, 6])}
    assert _same(spark, "joined_databases", tables(lineitem=made)) == 2


def test_list_of_a_cluster_holds_all_its_members(spark, tables):
    docs = {"doc_id": pa.array([1, 150, 990], pa.int64()), "lang": ["en"] * 3, "source": ["web"] * 3, "n_chars": pa.array([5, 9, 9], pa.int64()), "text": ["a"] * 3}
    sf_dir = tables(documents=docs)
    assert _same(spark, "nr_list", sf_dir) == 1
    assert tuple(bindings.queries()["nr_list"](spark, sf_dir).select("representative", "others").first()) == (150, "1 990")


@pytest.mark.parametrize("name", ["closest_points", "relative_angles", "three_axes_angles"])
def test_short_axes_that_are_nearly_parallel(spark, tables, name):
    """Directions of a tenth of the unit length: their determinant is below the bound for unit vectors."""
    axis = [0.1, 0.02, -0.03]
    near = [[0.3, 0.1, 0.2, *axis, -0.1, 0.4, 0.25, 0.1, 0.02 + d, -0.03, 0.2, -0.3, 0.15, 0.1, 0.02, d - 0.03] for d in (1e-2, 1e-3, 2e-4)]
    made = {"vec_id": pa.array([1, 2, 3], pa.int64()), "embedding": pa.array(near, pa.list_(pa.float32())), "label": pa.array([0, 1, 2], pa.int32())}
    assert _same(spark, name, tables(embeddings=made)) == 3


def test_products_in_blocks(spark):
    """Rows of several blocks, null vectors and labels, other lengths; the best are those of all rows, in time that rows one by one would not keep."""
    rng = random.Random(3)
    rows = [(k, [rng.random() for _ in range(3)], k % 2) for k in range(1200)] + [(2000, None, 1), (2001, [1.0, None, 2.0], 1), (2002, [1.0, 2.0], None)]
    d = spark.createDataFrame(rows, "k long, v array<double>, l int")
    vectors = {k: v for k, v, _ in rows}
    got = {(r.query_id, r.k): (r.score, r.label) for r in pairs.products(d.where("k % 100 = 0"), d, "k", "v", "l").collect()}
    assert len(got) == 13 * 1203 - 13
    for (q, k), (score, label) in got.items():
        a, b = vectors[q], vectors[k]
        fits = a is not None and b is not None and len(a) == len(b) and None not in a + b
        assert score == (round(sum(x * y for x, y in zip(a, b)), 9) if fits else None) and label == (None if k == 2002 else int(q % 2 == k % 2) if q < 2000 and k < 2000 else int((1 if q >= 2000 else q % 2) == (1 if k >= 2000 else k % 2)))
    best = pairs.products(d.where("k = 100"), d.where("k < 2000"), "k", "v", "l", best=5).collect()
    top = sorted((-s, k) for (q, k), (s, _) in got.items() if q == 100 and s is not None)[:5]
    assert sorted((-r.score, r.k) for r in best)[:5] == top and len(best) < 300


def test_constraints_meet_each_two_matches_once(spark):
    matches = spark.createDataFrame([(1, i, j) for i in range(3) for j in range(3)], "matrix int, i int, j int")
    d = align.match_constraints(matches, "matrix")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert d.count() == 18 + 9 * 7 + 9 * 2
