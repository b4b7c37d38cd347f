"""Steps that meet their rows once: what their plans sort, join and compute, and results that such plans could miss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helispan.operators import build, drawing, runs
from helispan.plans import bindings
from helispan.sinks import text as sinks
from helispan.sources import text
from tests.oracle import SF_DIR


def plan(df):
    """The plan before it is run; a result that was collected has a second one."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sorted_joins(spark):
    """Small tables too are joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_segments_are_sorted_once(spark):
    """Intervals and gaps of repeated integers, nulls and a null group; no table of all rows is held."""
    d = spark.createDataFrame([("a", x) for x in (5, 5, 6, 9, 9, None, None, 7, -1)] + [("b", 3), (None, 1), (None, 2)], "k string, x long").repartition(3)
    found = runs.segments(d, ["k"], "x")
    assert {tuple(r) for r in found.collect()} == {("a", None, None, 1), ("a", -1, -1, 1), ("a", 5, 7, 3), ("a", 9, 9, 1), ("b", 3, 3, 1), (None, 1, 2, 2)}
    assert {tuple(r) for r in runs.gaps(found.where("lo is not null"), ["k"], "lo", "hi").collect()} == {("a", 0, 4), ("a", 8, 8)}
    assert "HashAggregate" not in plan(found) and plan(found).count("Sort [") == 1


def test_lists_pass_unsorted(spark, sorted_joins):
    s = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 5)], "k long, lo long")
    ids = spark.createDataFrame([(1,), (1,), (7,), (None,)], "k long")
    found, missing = build.chosen(s, ids, ["k"]), build.unknown(s, ids, ["k"])
    assert sorted(r.lo for r in found.collect()) == [10, 11] and sorted(repr(r.k) for r in missing.collect()) == ["7", "None"]
    assert "SortMergeJoin" not in plan(found) + plan(missing)


@pytest.mark.parametrize("name", ["dssp_bonds", "dssp_bridges", "dssp_residues"])
def test_residue_lines_are_made_once(spark, name):
    """What is asked of a line's fields is not asked of the expression that makes the line."""
    d = bindings.queries()[name](spark, SF_DIR)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("format_string") <= (1 if name == "dssp_residues" else 2)


def test_code_matrices_meet_once(spark, sorted_joins):
    body = ["", "2", "OT", "xa  --", " "]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(body)] + [("b", 0, "3"), ("b", 1, "OT"), ("c", 0, "OT")], "path string, n long, line string")
    d = text.read_code_matrix(rows)
    assert sorted(tuple(r) for r in d.select("path", "i", "j", F.coalesce("code", F.lit("")).alias("c")).collect()) == [("a", 0, 0, "OT"), ("a", 0, 1, "xa"), ("a", 1, 1, "")]
    assert "Join" not in plan(d) and plan(d).count("Exchange") == 1


def test_drawings_are_written_in_their_rows(spark, sorted_joins):
    d = bindings.queries()["drawing_documents"](spark, SF_DIR)
    assert "Join" not in plan(d) and plan(d).count("Exchange") == 1
    shapes = spark.createDataFrame([(1, i, "strand", 10.0 * i, 0.0, 4.0, 2.0, "ffff00", None) for i in (5, 3)] + [(None, 1, "strand", 0.0, 0.0, 1.0, 1.0, "ffff00", "x")], "k long, id long, kind string, x double, y double, width double, height double, fill string, label string")
    clusters = spark.createDataFrame([(1, c, i, "eeeeee") for c, i in (("b%", 3), ("b%", 5), ("a<", 5), ("none", 9))] + [(2, "lost", 1, "eeeeee")], "k long, cluster string, id long, fill string")
    lines = spark.createDataFrame([(1, 5, 3, 0.0, 0.0, 1.0, 1.0, "TOP", "LEFT", "00%d00"), (1, 5, 9, 0.0, 0.0, 1.0, 1.0, "TOP", "LEFT", "000000")], "k long, src long, dst long, x1 double, y1 double, x2 double, y2 double, src_port string, dst_port string, colour string")
    guides = spark.createDataFrame([(1, 0, "x", 3), (1, 0, "x", 5)], "k long, guide int, axis string, id long")
    (row,) = sinks.svg_drawing(shapes, clusters, lines, guides, ["k"]).collect()
    assert row.text.split("\n") == [
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="28.00 -1.00 24.00 2.00">',
        '<rect id="1" class="strand" x="28.00" y="-1.00" width="4.00" height="2.00" fill="#ffff00"><title></title></rect>',
        '<rect id="2" class="strand" x="48.00" y="-1.00" width="4.00" height="2.00" fill="#ffff00"><title></title></rect>',
        '<g id="3" class="cluster" data-members="2" fill="#eeeeee"><title>a&lt;</title></g>',
        '<g id="4" class="cluster" data-members="1 2" fill="#eeeeee"><title>b%</title></g>',
        '<path id="5" class="connector" d="M 0.00 0.00 L 1.00 1.00" data-src="2" data-src-port="TOP" data-dst="1" data-dst-port="LEFT" stroke="#00%d00"/>',
        '<constraint id="6" type="alignment" axis="x" members="1 2"/>',
        "</svg>",
    ]


def test_drawings_are_placed_together(spark):
    """Many drawings at once get the places of each alone, with pairs missing, given twice or to strangers, and boxes in the way."""
    rng = random.Random(7)
    wanted, rows = {}, []
    for k in range(120):
        n = rng.choice([1, 2, 3, 5, 9, 20])
        ids = rng.sample(range(-50, 50), n)
        boxes = [(i, rng.random() < 0.3, float(rng.randint(10, 200)), float(rng.randint(10, 200))) for i in ids]
        near = [(float(rng.randint(0, 6)), a, b, rng.choice(drawing._SIDES)) for a in ids for b in [*ids, 99] if rng.random() < 0.7]
        near += [(d + 1, a, b, "LEFT") for d, a, b, _ in near[:3]]
        wanted[k] = sorted(drawing._place_alone(boxes, near, 55.0))
        rows.append((k, [(i, "sheet" if s else None, w, h) for i, s, w, h in boxes], [(a, b, d, p) for d, a, b, p in near] + [(ids[0], None, 0.0, "LEFT")]))
    d = spark.createDataFrame(rows, "k long, elements array<struct<id:long,kind:string,width:double,height:double>>, pairs array<struct<ref:long,test:long,dist:double,position:string>>")
    found = {}
    for r in drawing.place_listed(d, ["k"]).collect():
        found.setdefault(r.k, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == wanted
    big = spark.createDataFrame([(1, [(i, "sheet", 10.0, 10.0) for i in range(drawing.TOGETHER + 5)], [(0, 1, float("nan"), "LEFT"), (1, 2, 1.0, "ABOVE")])], d.schema)
    assert drawing.place_listed(big, ["k"]).select("id").distinct().count() == drawing.TOGETHER + 5
    assert np.isfinite([v for r in drawing.place_listed(big, ["k"]).collect() for v in (r.x, r.y)]).all()


def test_placed_boxes_bring_lines_together_once(spark, sorted_joins):
    d = plan(bindings.queries()["placed_boxes"](spark, SF_DIR))
    assert "Join" not in d and d.count("Exchange") == 1
