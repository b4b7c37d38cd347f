"""Strands, layout, database building and text outputs on worked examples and against plain loops."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from helispan.operators import align, axis, build, layout, strands
from helispan.sinks import text as sink
from helispan.sources import text

BRIDGES = "s int, node long, other long, side string, parallel boolean, low_own long, low_other long, high_own long, high_other long"


def _both(s, a, b, side_a=".", side_b=".", parallel=False, bonds=(None,) * 4):
    """A bridge in both directions; ``bonds`` as seen from a."""
    back = (bonds[1], bonds[0], bonds[3], bonds[2])
    return [(s, a, b, side_a, parallel, *bonds), (s, b, a, side_b, parallel, *back)]


def test_closing_edges_and_opening(spark):
    ring = [r for a, b in ((1, 2), (2, 3), (3, 4), (1, 4)) for r in _both(1, a, b)] + _both(2, 5, 6)
    d = spark.createDataFrame(ring, BRIDGES)
    cut = strands.closing_edges(d, ["s"])
    assert [tuple(r) for r in cut.collect()] == [(1, 1, 4)]
    left = strands.opened(d, cut, ["s"])
    assert {(r.node, r.other) for r in left.where("s = 1").collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)} and left.where("s = 2").count() == 2


def test_strand_order(spark):
    """A barrel of four, opened at 1-4; a branched sheet by sides; a lone strand."""
    rows = [r for a, b in ((1, 2), (2, 3), (3, 4), (1, 4)) for r in _both(1, a, b, parallel=a == 2)]
    # Strand 11 has 10 on one side, and 12 and 13 on the other, above each other.
    rows += _both(2, 10, 11, "+", "+") + _both(2, 11, 12, "-", "+") + _both(2, 11, 13, "-", "+", parallel=True, bonds=(2, 3, 5, 6))
    own = [(1, n, 1, 8) for n in (1, 2, 3, 4)] + [(2, n, 1, 8) for n in (10, 11, 12, 13)] + [(3, 20, 1, 5)]
    got = {r.node: r for r in strands.order_strands(spark.createDataFrame(own, "s int, node long, lo long, hi long"), spark.createDataFrame(rows, BRIDGES), ["s"]).collect()}
    assert [got[n].place for n in (1, 2, 3, 4)] == [0, 1, 2, 3] and [got[n].barrel for n in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[n].reversed for n in (1, 2, 3, 4)] == [False, True, True, False]
    assert [got[n].place for n in (10, 11, 12, 13)] == [0, 1, 2, 2] and got[13].reversed == got[11].reversed != got[12].reversed
    # 11 points down: bonds nearest to its first residue count; 13 begins where its bond allows.
    assert got[13].offset - got[11].offset == (2 - 1) - (3 - 1)
    assert (got[20].place, got[20].offset, got[20].reversed) == (0, 0, False)


def test_place_elements(spark):
    elements = [(1, 1, "helix", 9.0), (1, 2, "sheet", 30.0), (1, 3, "helix", 5.0), (1, 4, "helix", 4.0), (1, 5, "helix", 1.0), (2, 7, "helix", 2.0), (2, 8, "helix", 3.0)]
    pairs = [(1, 2, 1, 5.0, "LEFT"), (1, 2, 3, 6.0, "LEFT"), (1, 1, 3, 9.0, "ABOVE"), (1, 2, 4, 7.0, "LEFT"), (1, 1, 4, 8.0, "ABOVE")]
    d = layout.place_elements(spark.createDataFrame(elements, "s int, id long, kind string, size double"), spark.createDataFrame(pairs, "s int, ref long, test long, dist double, position string"), ["s"])
    got = {(r.s, r.id): (r.step, r.reference, r.position, r.column, r.row) for r in d.collect()}
    assert got[1, 2] == (0, None, None, 0, 0) and got[1, 1] == (1, 2, "LEFT", -1, 0)
    assert got[1, 3] == (2, 1, "ABOVE", -1, -1)  # the slot is taken, so it goes by its occupant
    assert got[1, 4] == (3, 1, "LEFT", -2, 0)  # that slot is taken as well: the first free one
    assert got[1, 5] == (4, None, None, 1, 0) and got[2, 8][:1] == (0,) and got[2, 7] == (1, None, None, 1, 0)


def test_helix_clusters(spark):
    near = [(1, 1, 2, 5.0), (1, 2, 3, 6.9), (1, 1, 3, 7.0), (1, 3, 4, 1.0)]
    h = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)] + [(2, 9)], "s int, id long")
    got = {r.id: r.cluster for r in layout.helix_clusters(h, spark.createDataFrame(near, "s int, src long, dst long, dist double"), ["s"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 9: 0}


def test_colour_schemes(spark):
    d = spark.createDataFrame([(1, i, "strand", "A") for i in range(4)], "s int, id int, kind string, sheet string")
    assert {r.colour for r in layout.node_colours(d, ["s"], "id", "none").collect()} == {"ffffff"}
    assert [r.colour for r in layout.node_colours(d, ["s"], "id", "gradient").orderBy("id").collect()][0] == "0000ff"
    with pytest.raises(ValueError, match="scheme"):
        layout.node_colours(d, ["s"], "id", "other")


def test_three_axes_angle(spark):
    from helispan.functions import geometry

    names = ["c1", "d1", "c2", "d2", "c3", "d3"]
    one = [(1.0, 0.0, 0.0), (0.0, 0.1, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 5.0), (0.1, 0.0, 1.0)]
    flat = [one[0], (0.0, 0.0, 2.0), *one[2:]]
    d = spark.createDataFrame([(0, *one), (1, *flat)], "id int, " + ", ".join(f"{n} struct<x:double,y:double,z:double>" for n in names))
    got = {r.id: r.a for r in geometry.three_axes_angle(d, list(zip(names[::2], names[1::2], strict=True)), "a").select("id", "a").collect()}
    assert abs(abs(got[0]) - math.pi / 2) < 1e-9 and got[1] is None


def _atom(chain, res, x, y, z):
    return f"ATOM      1  CA  ALA {chain}{res:4d}    {x:8.3f}{y:8.3f}{z:8.3f}"


def test_from_files_to_a_search(spark, tmp_path):
    """Cards and atoms of two files become a database that is searched with one of its matrices."""
    for name, turn in (("pdb1aaa", 0.0), ("pdb1bbb", 1.0)):
        atoms = [_atom("A", i, math.cos(1.7 * i), math.sin(1.7 * i), 1.5 * i) for i in range(1, 7)]
        atoms += [_atom("A", i, 8 + turn * i, 3.3 * i, (i % 2) * 0.5) for i in range(11, 15)]
        cards = [f"{'HELIX':<19}A {1:>5}{'     A ':<7}{6:>5} 1", f"{'SHEET':<21}A{11:>5}{'     A':<6}{14:>5} 0"]
        (tmp_path / f"{name}.ent").write_text("\n".join([*cards, *atoms]))
    rows = text.lines(spark, str(tmp_path), "*.ent").withColumn("path", text.structure_id(F.col("path")))
    cards = text.read_cards(rows)
    kind = F.when(F.col("kind") == "E", "strand").otherwise(F.col("helix"))
    segments = cards.select("path", "chain", kind.alias("kind"), F.col("start").cast("long").alias("lo"), F.col("stop").cast("long").alias("hi"))
    atoms = text.read_atoms(rows).select("path", "chain", F.col("res").cast("long").alias("ord"), "x", "y", "z")
    db = build.database(segments, atoms, ["path"], "chain")
    got = {r.path: r for r in db.collect()}
    assert set(got) == {"1AAA", "1BBB"} and all(r.types == "HE" and r.codes[0] == "xa" and r.codes[2] == "e " and len(r.codes) == 3 for r in got.values())
    scores = {r.path: r.score for r in align.search(db.withColumnRenamed("codes", "packed"), db.where("path = '1AAA'").select(F.col("path").alias("query_id"), F.col("codes").alias("packed")), key="path").collect()}
    assert scores["1AAA"] == 8 and set(scores) == set(got)
    both = build.joined(db, db.where("path = '1AAA'"), ["path"], "codes", "dists")
    assert {r.path: r.outcome for r in both.collect()} == {"1AAA": "joined", "1BBB": "missing"}
    out = build.joined_text(both, "path").first().text.split("\n")
    assert out[0] == "1AAA      2" and out[1] == "xa" and len(out) == 5
    assert build.database(segments.where("false"), atoms, ["path"], "chain").count() == 0


def test_nodes_and_axes_without_atoms(spark):
    segments = spark.createDataFrame([("x", "A", "alpha", 1, 5), ("x", "A", "strand", 9, 12), ("x", "B", "pi", 1, 9)], "path string, chain string, kind string, lo long, hi long")
    atoms = spark.createDataFrame([("x", "A", i, float(i), 0.0, 0.0) for i in range(1, 6)], "path string, chain string, ord long, x double, y double, z double")
    row = build.database(segments, atoms, ["path"], "chain").first()
    assert row.types == "HE" and row.codes[1] == "PE" and row.omegas[1] is None and row.dists[1] is None
    assert build.nodes(segments, ["path"], "chain", with_pi=True).count() == 3


def test_stride_lines(spark):
    lines = ["FA1 AntiPar From: - - 3 69 69 3", "FA1 Odd From: - - 1 2 3 4", "DNR  GLY - 12   11 ->  ALA A  30   29  2.9"]
    d = spark.createDataFrame([("p", i, line) for i, line in enumerate(lines)], "path string, n int, line string")
    assert {tuple(r) for r in text.read_stride_bridges(d).collect()} == {("p", "-", "3", "-", "69", "N"), ("p", "-", "69", "-", "3", "N")}
    assert text.read_stride_bonds(d).count() == 1


def test_quadratic_terms(spark):
    a = spark.createDataFrame([(1, i, k, "OT", "e", "h" if k else "e") for i in (0, 1) for k in (0, 1)], "key int, i int, k int, code string, kind string, kind_k string")
    b = spark.createDataFrame([(1, 2, j, l, "OT", "e", "h" if l else "e") for j in (0, 1) for l in (0, 1)], "key int, m int, j int, l int, code2 string, kind2 string, kind2_l string")
    got = {(r.p, r.q): r.value for r in align.quadratic_terms(a, b, "key", F.lit(2)).collect()}
    assert got == {(0, 3): 2.0, (3, 0): 2.0, (1, 2): -999.0, (2, 1): -999.0}


def test_texts(spark):
    seg = spark.createDataFrame([(1, 1, "A", "alpha", 3, 9), (1, 0, "A", "strand", 1, 2)], "s int, seg int, chain string, kind string, lo long, hi long")
    assert sink.segment_info(seg, ["s"]).first().text == "2\nE A 1 2\nH A 3 9"
    assert sink.selection_script(seg, ["s"]).first().text.split("\n")[0] == "select strand_0, chain A and resi 1-2"
    fitted = axis.axes(spark.createDataFrame([(1, 0, "strand", i, float(i), 0.0, 0.0) for i in range(4)], "s int, seg int, kind string, ord int, x double, y double, z double"), ["s"])
    assert sink.plot_script(fitted, ["s"]).first().text == "hold on\nplot3([1.500 2.500],[0.000 0.000],[0.000 0.000])"
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, math.pi / 2), (1, 1, None)], "i int, j int, v double")
    assert [r.c.strip() for r in cells.select(sink.degree_cell(F.col("v"), F.col("i") == F.col("j")).alias("c")).collect()] == ["-999.0", "90.0", "-999.0"]
    c = align.match_constraints(spark.createDataFrame([(1, i, j) for i in (0, 1) for j in (0, 1)], "matrix int, i int, j int"), "matrix")
    lines = {r.line for r in sink.constraint_lines(c).collect()}
    assert "+1 y_0_0 +1 y_0_1 <= 1;" in lines and "+1 x_0_0_1_1 -1 y_0_0 <= 0;" in lines and "+1 y_0_1 +1 y_1_0 <= 1;" in lines and len(lines) == 8
    goal = spark.createDataFrame([(1, "min: -2 x0;")], "matrix int, line string")
    whole = sink.lp_text(goal, sink.constraint_lines(c), c.select("matrix", "variable").distinct()).first().text
    assert whole.startswith("Minimize\n-2 x0\nSubject To\n") and whole.endswith("x_0_0_1_1 y_0_0 y_0_1 y_1_0 y_1_1\nEnd")
    shapes = spark.createDataFrame([("line", 1.0, 2.0, 3.0, 4.0, "ff0000", None), ("text", 1.0, 2.0, 0.0, 0.0, None, "a<b")], "kind string, x double, y double, width double, height double, fill string, label string")
    got = [r.e for r in shapes.select(sink.svg_elements(shapes).alias("e")).collect()]
    assert got[0] == '<line x1="1.00" y1="2.00" x2="4.00" y2="6.00" stroke="#ff0000"/>' and got[1].endswith(">a&lt;b</text>")
    members = spark.createDataFrame([(1, 2, "A", "aaaaaa"), (1, 1, "A", "aaaaaa")], "s int, id int, sheet string, fill string")
    assert 'data-members="1 2"' in sink.svg_clusters(members, ["s"], "sheet", "fill").first().element
    assert sink.svg_constraints(spark.createDataFrame([(1, 0, 5), (1, 0, 4)], "s int, place int, node int"), ["s"]).first().element == '<constraint type="alignment" guide="0" members="4 5"/>'
    con = spark.createDataFrame([(1, 2, "TOP", "BOTTOM")], "src int, dst int, src_port string, dst_port string")
    assert con.select(sink.svg_connectors(con).alias("e")).first().e == '<path class="connector" data-src="1" data-src-port="TOP" data-dst="2" data-dst-port="BOTTOM"/>'


def test_many_small_sheets_in_batches(spark):
    """A frame for each sheet took milliseconds: these would take minutes."""
    sheets = spark.range(60_000).select(F.col("id").alias("s"))
    ring = sheets.select("s", F.inline(F.array(*[F.struct(F.lit(a).alias("node"), F.lit(b).alias("other")) for a, b in ((1, 2), (2, 3), (1, 3))])))
    begun = time.monotonic()
    cut = strands.closing_edges(ring, ["s"]).agg(F.count("*"), F.min("src"), F.max("src"), F.min("dst"), F.max("dst")).first()
    assert tuple(cut) == (60_000, 1, 1, 3, 3) and time.monotonic() - begun < 30
