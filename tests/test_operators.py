"""Worked examples and properties of the library's operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helispan.functions import geometry, scalar
from helispan.operators import align, axis, cascade, community, domains, evaluate, pairs, ranges, runs, sheets
from helispan.operators.graph import connected_components

TWO_TRIANGLES = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


@pytest.fixture(scope="module")
def triangles(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in TWO_TRIANGLES], "k int, src long, dst long")
    groups = spark.createDataFrame([(1, n, n // 3) for n in range(6)], "k int, node long, group int")
    return edges, groups


def test_angle_codes(spark):
    given = [-0.9, -0.75, -0.5, -0.25, -0.1, 0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0]
    want = "OS OS LS LE PE PE PD PD RD RT RT OT OT".split()
    d = spark.createDataFrame([(i, x * math.pi) for i, x in enumerate(given)], "i int, x double")
    assert [r.c for r in d.select("i", scalar.angle_code(F.col("x")).alias("c")).orderBy("i").collect()] == want
    bad = spark.createDataFrame([(4.0,), (float("nan"),), (None,)], "x double").select(scalar.angle_code(F.col("x")).alias("c")).collect()
    assert [r.c for r in bad] == ["??", None, None]


def test_scores(spark):
    d = spark.createDataFrame([("OT", "OT"), ("OT", "OS"), ("OT", "RT"), ("OT", "PE"), ("xa", "xa"), ("xa", "e "), ("xa", "OT")], "a string, b string")
    rows = d.select(scalar.score_codes(F.col("a"), F.col("b")).alias("p"), scalar.score_codes_typed(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.p for r in rows[:4]] == [2, 1, 1, -2] and [r.t for r in rows] == [2, 1, 1, -2, 0, scalar.MISMATCH, scalar.MISMATCH]
    r = spark.range(1).select(scalar.score_radians(F.lit(0.1), F.lit(0.1)).alias("a"), scalar.score_radians(F.lit(-3.1), F.lit(3.1)).alias("b"), scalar.score_degrees(F.lit(-3.1), F.lit(3.1)).alias("c")).first()
    assert abs(r.a - math.pi / 4) < 1e-12 and abs(r.b - (math.pi / 4 - 2 * math.pi + 6.2)) < 1e-12 and abs(r.c - math.degrees(r.b)) < 1e-9


def test_small_scalars(spark):
    d = spark.createDataFrame([("60",), ("60A",), ("-3B",), ("x",)], "r string").select(scalar.residue(F.col("r")).alias("r"))
    assert [tuple(r.r) for r in d.collect()] == [(60, None), (60, "A"), (-3, "B"), (None, None)]
    r = spark.range(1).select(
        scalar.packed_index(F.lit(2), F.lit(1)).alias("p"), scalar.hsv_to_hex(F.lit(240.0)).alias("h"), scalar.repaired_sid(F.lit("g1avo_4")).alias("s"), scalar.chain_id(F.lit(" ")).alias("c"), scalar.flat_index([3, 4], F.lit(2), F.lit(1)).alias("f")
    ).first()
    assert (r.p, r.h, r.s, r.c, r.f) == (4, "0000ff", "d1avoa4", "-", 9)


def test_geometry(spark):
    v = lambda *x: geometry.vec(*map(F.lit, x))
    r = spark.range(1).select(
        geometry.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 0, 1), v(0, 1, 1)).alias("d"),
        geometry.closest(v(0, 0, 0), v(1, 0, 0), v(3, 1, 2), v(3, 2, 2)).alias("c"),
        geometry.closest(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(1, 1, 0)).alias("none"),
        geometry.project(v(0, 0, 0), v(2, 0, 0), v(5, 7, 9)).alias("p"),
    ).first()
    assert abs(abs(r.d) - math.pi / 2) < 1e-12 and r.none is None and tuple(r.p) == (5, 0, 0)
    # A short line between the closest points has an angle all the same; three points on a line, or one point twice, have none.
    near = [geometry.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 0, h), v(0, 1, h)).alias(f"n{k}") for k, h in enumerate((1e-4, 1e-9, 0.0))]
    n = spark.range(1).select(*near, geometry.dihedral(v(0, 0, -1), v(0, 0, 0), v(0, 0, 1), v(0, 1, 1)).alias("line")).first()
    assert abs(abs(n.n0) - math.pi / 2) < 1e-9 and abs(abs(n.n1) - math.pi / 2) < 1e-6 and n.n2 is None and n.line is None
    assert tuple(r.c.pa) == (3, 0, 0) and tuple(r.c.pb) == (3, 0, 2)


def test_axes_and_matrices(spark):
    rng = np.random.default_rng(0)
    for helix in (True, False):
        line = np.arange(12)[:, None] * np.array([0.0, 0.6, 0.8]) + rng.normal(size=(12, 3)) * 0.01
        centre, direction = axis.fit_axis(line, helix)
        assert direction @ np.array([0.0, 0.6, 0.8]) > 0.999
    assert axis.fit_axis(np.zeros((2, 3)), True) is None and axis.fit_axis(np.zeros((1, 3)), False) is None
    rows = [("s", seg, "strand" if seg else "alpha", i, *(np.array([seg * 10.0, 0, 0]) + i * np.array(d, float))) for seg, d in enumerate([(0, 0, 1), (0, 1, 0), (0, 1, 1)]) for i in range(8)]
    atoms = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], "id string, seg int, kind string, ord int, x double, y double, z double")
    m = {(r.i, r.j): r for r in axis.matrices(axis.axes(atoms, ["id"]), ["id"]).collect()}
    assert [m[k, k].code for k in range(3)] == ["xa", "e ", "e "] and m[0, 0].omega == 1.0
    assert abs(abs(m[0, 1].omega) - math.pi / 2) < 1e-6 and abs(abs(m[0, 2].omega) - math.pi / 4) < 1e-6 and len(m) == 6


def test_curve_and_area(spark):
    d = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 0), (3.0, "c", 1), (4.0, "d", 0), (5.0, "e", 1)], "score double, id string, label int").repartition(3)
    curve = evaluate.rank_curve(d, "id", "score", "label").orderBy("score").collect()
    assert [r.fp for r in curve] == [3, 2, 1, 1, 0] and [r.tpr for r in curve] == [1, 1, 1, 0.5, 0.5]
    assert abs(evaluate.area(d, "id", "score", "label").first().auc - 5 / 6) < 1e-12


def test_overlap_repair(spark):
    d = spark.createDataFrame([(1, 1, 10), (1, 8, 12), (2, 1, 4), (2, 3, 20), (3, 1, 5), (3, 6, 9)], "k int, lo long, hi long")
    got = {(r.k, r.lo, r.hi) for r in runs.repaired_overlaps(d, ["k"], "lo", "hi").collect()}
    assert got == {(1, 1, 7), (1, 8, 12), (2, 1, 4), (2, 5, 20), (3, 1, 5), (3, 6, 9)}


def test_graph_measures(triangles):
    edges, groups = triangles
    assert abs(community.modularity(edges, groups, ["k"]).first().modularity - 5 / 14) < 1e-12
    assert abs(community.ratio_cut(edges, groups, ["k"]).first().ratio_cut - 2 / 3) < 1e-12
    row = community.cycles(edges, connected_components(edges)).first()
    assert (row.component, row.n_nodes, row.n_edges, row.n_cycles) == (0, 6, 7, 2)


def test_chain_domains(spark):
    chain = [(1, n, n + 1) for n in range(24)]
    edges = [(1, a, b) for a in range(24) for b in range(a) if a // 12 == b // 12 or a - b == 1]
    d = community.chain_domains(spark.createDataFrame(chain, "k int, node long, seq int"), spark.createDataFrame(edges, "k int, src long, dst long"), ["k"])
    assert {r.node: r.domain for r in d.collect()} == {n: n // 12 for n in range(24)}


def test_queries_in_blocks(spark):
    queries, rows = spark.range(7).withColumnRenamed("id", "q"), spark.range(20)
    assert {tuple(sorted(r.asDict().items())) for r in pairs.against(queries, rows, "q", block=2).collect()} == {(("id", i), ("q", q)) for i in range(20) for q in range(7)}


def test_running_totals_by_key(spark):
    d = spark.createDataFrame([(k, float(i % 5), i) for k in (1, 2, 3) for i in range(40)], "k int, s double, i int").repartition(5)
    for r in evaluate.rank_curve(d.withColumn("y", F.col("i") % 2), "i", "s", "y", ("k",)).collect():
        later = [i for i in range(40) if (i % 5, i) >= (r.s, r.i)]
        assert (r.tp, r.fp) == (sum(i % 2 for i in later), sum(1 - i % 2 for i in later))


def test_components_against_union_find(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(1000, 1100)] + [(7777, 7777)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent}


def test_alignment(spark):
    a, b = "GGGGGACCCTTTACAAC", "GGGCACCCCAAC"
    score, path = align.align(np.array([[float(x == y) for y in b] for x in a]), -1.0)
    assert score == 7
    one, two = align.alignment_strings(a, b, path)
    assert len(one) == len(two) and one.replace("-", "").replace("~", "") == a and two.replace("-", "").replace("~", "") == b
    d = spark.createDataFrame([(list(a), list(b)), ([], list(b)), (list(a), [])], "a array<string>, b array<string>")
    assert [r.s for r in d.select(align.align_score(F.col("a"), F.col("b")).alias("s")).collect()] == [7, 0, 0]


def test_matrix_search(spark):
    a, b = ["e ", "OT", "xa"], ["e ", "OT", "e ", "LE", "RT", "xa"]
    db = spark.createDataFrame([(1, a), (2, b)], "target_id int, packed array<string>")
    asked = lambda q: spark.createDataFrame([(0, q)], "query_id int, packed array<string>")
    score = lambda q, typed: {r.target_id: r.score for r in align.search(db, asked(q), typed=typed).collect()}
    assert score(a, False) == {1: 8, 2: 6} and score(b, False)[2] == 18 and score(b, True) == {1: 2, 2: 12}


def test_pack_round_trip(spark):
    rows = [(k, i, j, f"{k}{i}{j}") for k in (1, 2) for j in range(6) for i in range(j + 1)]
    packed = pairs.pack(spark.createDataFrame(rows, "k int, i long, j long, v string"), ["k"], "i", "j", "v")
    assert {tuple(r) for r in pairs.unpack(packed, ["k"]).select("k", "i", "j", "value").collect()} == set(rows)


def test_domain_scores(spark):
    found = [("p", r, 0 if r <= 37 or r >= 76 else 1) for r in range(1, 195)]
    reference = [("p", r, 7 if r <= 40 or r >= 80 else 8) for r in range(1, 195)]
    f, r = (spark.createDataFrame(x, "id string, res int, domain int") for x in (found, reference))
    got = domains.overlap_scores(f, r, ["id"], "res").first()
    assert (got.n_found, got.n_reference) == (2, 2) and abs(got.score - (194 - 3 - 4) / 194) < 1e-12
    assert domains.overlap_scores(f, r.where("domain = 7"), ["id"], "res").first().score == 0


def test_interval_subtraction(spark):
    d = spark.createDataFrame([(1, 1, 10), (2, 5, 6), (3, 20, 30)], "k int, lo int, hi int")
    got = {tuple(r) for r in domains.without(d, "lo", "hi", F.lit(4), F.lit(7)).collect()}
    assert got == {(1, 1, 3), (1, 8, 10), (3, 20, 30)}


def test_containment_with_open_intervals(spark):
    points = spark.createDataFrame([("a", 5), ("a", 500), ("b", 7)], "k string, at int")
    spans = spark.createDataFrame([("a", 1, 9, "x"), ("a", 5, 600, "y"), ("b", None, None, "z")], "k string, lo int, hi int, name string")
    got = {(r.k, r.at, r.name) for r in ranges.containing(points, spans, ["k"], "at", "lo", "hi", 10).collect()}
    assert got == {("a", 5, "x"), ("a", 5, "y"), ("a", 500, "y"), ("b", 7, "z")}


def test_representative_prefers_in_order(spark):
    d = spark.createDataFrame([(1, 10, False, None, 1), (1, 12, False, 2.0, 2), (1, 12, True, 3.0, 3), (1, 12, True, 2.5, 4)], "c int, len int, xray boolean, res double, id int")
    prefer = [-F.col("len"), ~F.col("xray"), F.coalesce("res", F.lit(1e9)), F.col("id")]
    assert cascade.representatives(d, ["c"], prefer, ["id"]).first().id == 4


def test_ratio_cut_domains(spark, triangles):
    edges, groups = triangles
    nodes = groups.select("k", "node", (F.col("node") + 1).alias("seq"))
    got = {(r.node, r.domain) for r in community.ratio_cut_domains(nodes, edges, ["k"]).collect()}
    assert got == {(n, n // 3) for n in range(6)}
    assert {r.domain for r in community.ratio_cut_domains(nodes, edges, ["k"], limit=0.5).collect()} == {0}
    assert {(r.node, r.domain) for r in community.ratio_cut_domains(nodes, edges.limit(0), ["k"]).collect()} == {(n, 0) for n in range(6)}


def test_orientation_and_top(spark):
    codes = ["PD", "KK", "OT", "HH", "LE", "RT"]
    d = spark.createDataFrame([(c, s, r) for c in codes for s in (False, True) for r in (False, True)], "c string, s boolean, r boolean")
    for row in d.select("*", sheets.orientation(F.col("c"), F.col("s"), F.col("r")).alias("o")).collect():
        assert row.o.sideways == ((row.c[0] in "LR") != row.s) and row.o.reversed == ((row.c[0] not in "PK") != row.r)
    at = spark.createDataFrame([(10, False), (15, False), (16, False), (16, True), (12, True)], "n int, r boolean")
    got = [x.t for x in at.select(sheets.nearer_top(F.col("n"), F.lit(10), F.lit(20), F.col("r")).alias("t")).collect()]
    assert got == [False, False, True, False, True]


def test_lists_of_clusters(spark):
    """A cluster's other members as one text and as rows; a cluster of one has none."""
    m = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("a", 2, 2.0), ("b", 9, 0.0)], "k string, id long, score double")
    chosen = cascade.representatives(m, ["k"], [-F.col("score"), F.col("id")], ["id", "score"])
    assert {(r.k, r.representative, r.others) for r in cascade.listed(m, chosen, ["k"], "id").collect()} == {("a", 1, "2 3"), ("b", 9, "")}
    assert {tuple(r) for r in cascade.others(m, chosen, ["k"], "id").collect()} == {("a", 1, 2), ("a", 1, 3)}
