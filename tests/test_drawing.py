"""Overlaps, crossings, colours, placed boxes and whole documents against plain versions."""

from __future__ import annotations

import math
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from helispan.functions import geometry
from helispan.operators import axis, build, drawing, layout
from helispan.operators.graph import connected_components
from helispan.sinks import text as sink
from helispan.sources import text

BOX = "k string, id long, x double, y double, width double, height double"
LINE = "k string, id long, src long, dst long, x1 double, y1 double, x2 double, y2 double"


def _overlap(a, b):
    return all(min(a[i] + a[i + 2] / 2, b[i] + b[i + 2] / 2) - max(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2) > 1e-6 for i in (0, 1))


def _cross(p, q):
    def turn(ax, ay, bx, by, cx, cy):
        v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (v > 0) - (v < 0)

    boxes = all(max(min(p[i], p[i + 2]), min(q[i], q[i + 2])) <= min(max(p[i], p[i + 2]), max(q[i], q[i + 2])) for i in (0, 1))
    return boxes and turn(*p, *q[:2]) * turn(*p, *q[2:]) <= 0 and turn(*q, *p[:2]) * turn(*q, *p[2:]) <= 0


def _drawings():
    rng = random.Random(8)
    boxes, lines = [], []
    for k in ("a", "b", "c"):
        own = [(k, i, float(rng.randint(-900, 900)), float(rng.randint(-900, 900)), float(rng.randint(1, 400)), float(rng.randint(1, 400))) for i in range(40)]
        boxes += own
        for i in range(40):
            s, d = rng.sample(own, 2)
            lines.append((k, i, s[1], d[1], s[2], s[3], d[2], d[3]))
    boxes += [("a", 90, None, 1.0, 2.0, 2.0), ("a", 91, 0.0, 0.0, 0.0, 5.0), ("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, 10.0, 0.0, 10.0, 10.0)]
    lines += [("d", 1, 1, 2, 0.0, 0.0, 10.0, 0.0), ("d", 2, 3, 4, 5.0, 0.0, 20.0, 0.0), ("d", 3, 5, 6, 0.0, 1.0, 10.0, 1.0), ("d", 4, 7, 8, 12.0, 0.0, 13.0, 9.0)]
    return boxes, lines


def _inside(line, box):
    """Whether some point of the line is inside the box, by a fine walk along it."""
    x1, y1, x2, y2 = line
    return any(abs(x1 + (x2 - x1) * t / 4000 - box[0]) < box[2] / 2 - 0.5 and abs(y1 + (y2 - y1) * t / 4000 - box[1]) < box[3] / 2 - 0.5 for t in range(4001))


def test_overlaps(spark):
    boxes, lines = _drawings()
    placed, drawn = spark.createDataFrame(boxes, BOX).repartition(3), spark.createDataFrame(lines, LINE).repartition(3)
    usable = [b for b in boxes if None not in b and b[4] > 0 and b[5] > 0]
    wanted = sorted((p[0], p[1], q[1]) for p in usable for q in usable if p[0] == q[0] and p[1] < q[1] and _overlap(p[2:], q[2:]))
    assert sorted(tuple(r) for r in drawing.box_overlaps(placed, ["k"]).collect()) == wanted and ("d", 1, 2) not in wanted and wanted
    crossed = sorted((p[0], p[1], q[1]) for p in lines for q in lines if p[0] == q[0] and p[1] < q[1] and not {p[2], p[3]} & {q[2], q[3]} and _cross(p[4:], q[4:]))
    found = drawing.line_crossings(drawn, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == crossed and ("d", 1, 2) in crossed and ("d", 1, 3) not in crossed
    covered = {tuple(r) for r in drawing.lines_through_boxes(drawn, placed, ["k"]).collect()}
    sure = {(p[0], p[1], b[1]) for p in lines for b in usable if p[0] == b[0] and b[1] not in p[2:4] and _inside(p[4:], b[2:])}
    assert sure <= covered and len(covered - sure) <= len(sure) // 20
    counts = {r.k: (r.boxes, r.crossings, r.covered, r.overlaps) for r in drawing.overlap_counts(placed, drawn, ["k"]).collect()}
    assert counts["b"][:2] == (sum(w[0] == "b" for w in wanted), sum(w[0] == "b" for w in crossed)) and all(v[3] == sum(v[:3]) for v in counts.values())
    trials = drawing.overlap_counts(placed, drawn, ["k"]).withColumn("gap", F.lit(55.0))
    assert {r.k: r.overlaps for r in layout.best_gap(trials, ["k"], "gap", "overlaps").collect()} == {k: v[3] for k, v in counts.items()}
    colours = {(r.k, r.id): r["rank"] for r in drawing.crossing_colours(drawn, found, ["k"]).collect()}
    assert len(colours) == len(lines) and all(colours[k, a] != colours[k, b] for k, a, b in crossed)
    assert all(set(range(c)) <= {colours[k, a] for kk, a, b in crossed if (kk, b) == (k, i)} for (k, i), c in colours.items())
    assert drawing.box_overlaps(placed.limit(0), ["k"]).count() == drawing.line_crossings(drawn.limit(0), ["k"]).count() == 0


def test_line_colours(spark):
    d = spark.createDataFrame([(0, False), (1, True), (12, True)], "chain int, inter boolean")
    get = lambda *a: [r.c for r in d.select(drawing.line_colour(a[0], F.col("chain"), F.col("inter"), *a[1:]).alias("c")).collect()]
    assert get("all") == ["000000"] * 3 and get("all", ["ff0000"]) == ["ff0000"] * 3
    assert get("chain", ["a", "b"]) == ["a", "b", "a"] and get("domain") == ["000000", "808080", "808080"]
    with pytest.raises(ValueError, match="no colour scheme"):
        get("none")


def _plain_ports(chain):
    """Node by node, the port that the connector before has entered carried along."""
    out, entered = [], None
    for a, b in zip(chain, chain[1:], strict=False):
        strand = lambda n: n["kind"] == "strand"
        enter = "TOP" if strand(b) and b["reversed"] else "BOTTOM"
        leave = ("BOTTOM" if strand(a) and a["reversed"] else "TOP") if entered is None else ("BOTTOM" if entered in ("TOP", "LEFT") else "TOP")
        if b["kind"] == "alpha":
            if b["between"] or b["last"]:
                enter = "TOP" if b["reversed"] else "BOTTOM"
            elif (a["x"] < b["x"]) if b["sideways"] else (a["y"] < b["y"]):
                enter, leave = "TOP", "BOTTOM"
        side = lambda p, n: {"TOP": "LEFT", "BOTTOM": "RIGHT"}[p] if n["sideways"] else p
        enter, leave = side(enter, b), side(leave, a)
        if b["kind"] == "terminus":
            enter = "DEFAULT"
        elif a["kind"] == "terminus":
            leave = "DEFAULT"
        entered = enter
        out.append((a["id"], b["id"], leave, enter))
    return out


def test_aligned_connectors(spark):
    rng = random.Random(2)
    rows, wanted = [], []
    for k in range(30):
        chain = [{"k": k, "id": i, "kind": rng.choice(["strand", "alpha", "alpha", "terminus"]), "x": rng.random(), "y": rng.random(), "reversed": rng.random() < 0.5, "sideways": rng.random() < 0.3, "between": rng.random() < 0.3, "last": i == 7} for i in range(8)]
        rows += chain
        wanted += [(k, *p) for p in _plain_ports(chain)]
    d = spark.createDataFrame([tuple(r.values()) for r in rows], "k long, id long, kind string, x double, y double, reversed boolean, sideways boolean, between boolean, last boolean").repartition(3)
    assert sorted(tuple(r) for r in drawing.aligned_connectors(d, ["k"], "id").collect()) == sorted(wanted)


def test_axis_rooms(spark):
    helices = spark.createDataFrame([(1, "A", "ABOVE", 1, i, 30.0, 50.0 + i) for i in range(3)] + [(1, "A", "ABOVE", 0, 9, 30.0, 40.0), (1, "A", "LEFT", None, 5, 30.0, 60.0), (1, "A", "BELOW", 1, 7, 30.0, 20.0)], "s int, sheet string, side string, column int, order int, width double, height double")
    sheets = spark.createDataFrame([(1, "A", 0.0, 110.0, -20.0, 80.0, 20.0)], "s int, sheet string, left double, right double, top double, bottom double, left_column double")
    got = {r.order: (r.x, r.y) for r in drawing.axis_rooms(helices, sheets, ["s"]).collect()}
    assert got[0] == (75.0, -20 - 55 - 25.0) and got[1] == (75.0, -20 - 55 - 50 - 55 - 25.5) and got[9] == (20.0, -95.0)
    assert got[5] == (-70.0, 30.0) and got[7] == (75.0, 80 + 55 + 10.0)
    boxes = spark.createDataFrame([("s", o, x, y, 30.0, 20.0) for o, (x, y) in got.items()], BOX)
    assert drawing.box_overlaps(boxes, ["k"]).count() == 0


def test_placed_boxes(spark):
    """No two boxes nearer than the gap, everything placed, the seed and the order of placement as told."""
    rng = random.Random(4)
    elements, pairs = [], []
    for k in range(6):
        n = 4 + 6 * k
        for i in range(n):
            elements.append((k, i, "sheet" if i % 5 == 3 else "alpha", float(rng.randint(30, 300)), float(rng.randint(30, 200))))
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.6:
                    d = float(rng.randint(1, 30))
                    pairs += [(k, a, b, d, rng.choice(["LEFT", "RIGHT", "ABOVE", "BELOW"])) for a, b in ((i, j), (j, i))]
    e = spark.createDataFrame(elements, "k long, id long, kind string, width double, height double")
    p = spark.createDataFrame(pairs, "k long, ref long, test long, dist double, position string")
    placed = drawing.place_boxes(e, p, ["k"])
    got = {(r.k, r.id): r for r in placed.collect()}
    size = {(k, i): (w, h) for k, i, _, w, h in elements}
    assert got.keys() == size.keys()
    for k in range(6):
        own = sorted((r for r in got.values() if r.k == k), key=lambda r: r.step)
        assert [r.step for r in own] == list(range(len(own))) and (own[0].x, own[0].y) == (0.0, 0.0)
        sheets = [i for i in range(len(own)) if i % 5 == 3]
        assert own[0].id == max(sheets, key=lambda i: (size[k, i][0] * size[k, i][1], -i))
        near = {(a, b): d for kk, a, b, d, _ in pairs if kk == k}
        for s in range(1, len(own)):
            done = {r.id for r in own[:s]}
            options = [(d, a, b) for (a, b), d in near.items() if a in done and b not in done]
            assert not options or own[s].id == min(options)[2]
        for i, a in enumerate(own):
            for b in own[:i]:
                (w, h), (v, g) = size[k, a.id], size[k, b.id]
                assert abs(a.x - b.x) >= (w + v) / 2 + 55 - 1e-5 or abs(a.y - b.y) >= (h + g) / 2 + 55 - 1e-5
    boxes = placed.join(e, ["k", "id"]).withColumn("domain", F.col("id") % 3)
    near = spark.createDataFrame([(k, a, b, float(a + b), "RIGHT") for k in range(6) for a in range(3) for b in range(3) if a != b], "k long, ref long, test long, dist double, position string")
    moved = drawing.place_domains(boxes, near, ["k"])
    ends = moved.groupBy("k", "domain").agg(F.min(F.col("x") - F.col("width") / 2).alias("l"), F.max(F.col("x") + F.col("width") / 2).alias("r"), F.min(F.col("y") - F.col("height") / 2).alias("t"), F.max(F.col("y") + F.col("height") / 2).alias("b")).collect()
    for a in ends:
        for b in ends:
            if a.k == b.k and a.domain < b.domain:
                assert a.r + 50 <= b.l + 1e-6 or b.r + 50 <= a.l + 1e-6 or a.b + 50 <= b.t + 1e-6 or b.b + 50 <= a.t + 1e-6
    assert drawing.place_boxes(e.limit(0), p.limit(0), ["k"]).count() == 0


def _atom(chain, res, x, y, z):
    return f"ATOM      1  CA  ALA {chain}{res:4d}    {x:8.3f}{y:8.3f}{z:8.3f}"


def _file(shift):
    """Two helices and a sheet of three strands, three residues to a turn."""
    atoms, cards = [], []
    for h, (lo, dx) in enumerate(((1, 0.0), (40, 25.0))):
        atoms += [_atom("A", lo + i, dx + math.cos(1.7 * i), math.sin(1.7 * i) + shift, 1.5 * i) for i in range(10)]
        cards.append(f"{'HELIX':<19}A {lo:>5}{'     A ':<7}{lo + 9:>5} 1")
    for s, lo in enumerate((15, 22, 29)):
        atoms += [_atom("A", lo + i, 10 + 4.8 * s, 3.3 * i * (1 - 2 * (s % 2)), (i % 2) * 0.5) for i in range(5)]
        bridge = f"{'':11}A{lo + 1:>5}{'':9}A{lo - 6:>5}" if s else ""
        cards.append(f"{'SHEET':<21}A{lo:>5}{'     A':<6}{lo + 4:>5}{-1 if s else 0:>2}" + (f"{'':9}A{lo + 1:>5}{'':9}A{lo - 6:>5}" if s else ""))
        assert not bridge or len(bridge) > 20
    return "\n".join([*cards, *atoms])


def test_from_files_to_a_drawing(spark, tmp_path):
    """Two files are parsed and drawn: boxes apart, every reference of the documents resolved, crossing lines in other colours."""
    for name, shift in (("pdb1aaa", 0.0), ("pdb2bbb", 9.0)):
        (tmp_path / f"{name}.ent").write_text(_file(shift))
    rows = text.lines(spark, str(tmp_path), "*.ent").withColumn("path", text.structure_id(F.col("path")))
    cards = text.read_cards(rows)
    kind = F.when(F.col("kind") == "E", "strand").otherwise(F.col("helix"))
    segments = cards.select("path", "chain", kind.alias("kind"), F.col("start").cast("long").alias("lo"), F.col("stop").cast("long").alias("hi"))
    atoms = text.read_atoms(rows).select("path", "chain", F.col("res").cast("long").alias("ord"), "x", "y", "z")
    nodes = build.nodes(segments, ["path"], "chain").withColumn("id", F.col("seg").cast("long")).cache()
    assert nodes.count() == 10
    inside = atoms.join(nodes.select("path", "chain", "id", "kind", "lo", "hi"), ["path", "chain"]).where("ord between lo and hi")
    axes = axis.axes(inside.withColumnRenamed("id", "seg"), ["path"]).select("path", F.col("seg").alias("id"), "centre", "direction")

    # Sheets are strands that bridges connect.
    bridges = text.read_card_bridges(rows).select("path", F.col("res1").cast("long").alias("r1"), F.col("res2").cast("long").alias("r2"))
    of = lambda r: nodes.select("path", F.col("id").alias(f"n{r}"), F.col("lo").alias(f"lo{r}"), F.col("hi").alias(f"hi{r}"))
    links = bridges.join(of(1), "path").where("r1 between lo1 and hi1").join(of(2), "path").where("r2 between lo2 and hi2")
    key = lambda c: F.concat_ws("/", "path", F.format_string("%04d", c))
    strands = nodes.where("kind = 'strand'")
    sheets = connected_components(links.select(key("n1").alias("src"), key("n2").alias("dst")).unionByName(strands.select(key("id").alias("src"), key("id").alias("dst"))))
    member = strands.withColumn("node", key("id")).join(sheets, "node").withColumn("sheet", F.col("component"))
    place = member.withColumn("place", F.row_number().over(drawing.Window.partitionBy("path", "sheet").orderBy("id")) - 1).withColumn("offset", F.lit(0))
    at = layout.strand_places(place.select("path", "id", "sheet", "place", "offset", "lo", "hi"), ["path", "sheet"])
    boxes = at.groupBy("path", "sheet").agg(F.min("id").alias("element"), F.min(F.col("x") - F.col("width") / 2).alias("l"), F.max(F.col("x") + F.col("width") / 2).alias("r"), F.min(F.col("y") - F.col("height") / 2).alias("t"), F.max(F.col("y") + F.col("height") / 2).alias("b"))
    helices = nodes.where("kind <> 'strand'").withColumn("_s", layout.extent(F.col("kind"), F.col("hi") - F.col("lo") + 1))
    elements = boxes.select("path", F.col("element").alias("id"), F.lit("sheet").alias("kind"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"))
    elements = elements.unionByName(helices.select("path", "id", "kind", "_s.width", "_s.height"))

    # The nearest nodes of two elements give their distance, and the first and last strand the side.
    home = at.join(boxes, ["path", "sheet"]).select("path", "id", "element", "place", F.max("place").over(drawing.Window.partitionBy("path", "sheet")).alias("most"))
    home = home.unionByName(helices.select("path", "id", F.col("id").alias("element"), F.lit(0).alias("place"), F.lit(0).alias("most"))).join(axes, ["path", "id"])
    a, b = (home.select("path", *[F.col(c).alias(f"{n}_{c}") for c in home.columns if c != "path"]) for n in "ab")
    two = a.join(b, "path").where("a_element <> b_element").withColumn("dist", geometry.distance(F.col("a_centre"), F.col("b_centre")))
    near = two.groupBy("path", "a_element", "b_element").agg(F.min_by(F.struct("a_place", "a_most", "dist"), F.struct("dist", "a_id", "b_id")).alias("n"))
    side = F.when(F.col("n.a_most") == 0, "RIGHT").when(F.col("n.a_place") == 0, "LEFT").when(F.col("n.a_place") == F.col("n.a_most"), "RIGHT").otherwise("ABOVE")
    pairs = near.select("path", F.col("a_element").alias("ref"), F.col("b_element").alias("test"), F.col("n.dist").alias("dist"), side.alias("position"))
    centres = drawing.place_boxes(elements, pairs, ["path"]).select("path", F.col("id").alias("element"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    inner = at.join(boxes, ["path", "sheet"]).join(centres, ["path", "element"])
    shapes = inner.select("path", "id", F.lit("strand").alias("kind"), (F.col("x") - (F.col("l") + F.col("r")) / 2 + F.col("cx")).alias("x"), (F.col("y") - (F.col("t") + F.col("b")) / 2 + F.col("cy")).alias("y"), "width", "height")
    shapes = shapes.unionByName(helices.join(centres, (helices["path"] == centres["path"]) & (helices["id"] == centres["element"])).select(helices["path"], "id", "kind", F.col("cx").alias("x"), F.col("cy").alias("y"), "_s.width", "_s.height")).cache()
    assert shapes.count() == 10 and drawing.box_overlaps(shapes, ["path"]).count() == 0

    flags = shapes.withColumns({"reversed": F.col("id") % 2 == 1, "sideways": F.lit(False), "between": F.lit(False), "last": F.lit(False)})
    lines = drawing.lines_of(drawing.aligned_connectors(flags, ["path"], "id"), shapes, ["path"]).cache()
    crossings = drawing.line_crossings(lines, ["path"])
    painted = lines.join(drawing.crossing_colours(lines, crossings, ["path"]).select("path", "id", "colour"), ["path", "id"])
    assert lines.count() == 8 and drawing.overlap_counts(shapes, lines, ["path"]).count() == 2
    filled = layout.node_colours(shapes.withColumn("sheet", F.lit(None).cast("string")), ["path"], "id", "simple").withColumnRenamed("colour", "fill").withColumn("label", F.concat(F.lit("<&>"), F.col("id").cast("string")))
    guides = at.select("path", F.col("place").alias("guide"), F.lit("x").alias("axis"), "id")
    documents = sink.svg_drawing(filled, member.select("path", F.col("sheet").alias("cluster"), "id", F.lit("eeeeee").alias("fill")), painted, guides, ["path"])
    got = {r.path: r.text for r in documents.collect()}
    assert set(got) == {"1AAA", "2BBB"}
    for svg in got.values():
        root = ET.fromstring(svg)
        elements_of = list(root)
        ids = [e.get("id") for e in elements_of]
        assert ids == [str(k + 1) for k in range(5 + 1 + 4 + 3)]
        shapes_of = {e.get("id") for e in elements_of if e.tag.endswith("rect")}
        names = [e.get("data-members") or e.get("members") for e in elements_of if e.get("data-members") or e.get("members")]
        assert len(names) == 4 and all(set(n.split()) <= shapes_of for n in names) and {len(n.split()) for n in names} == {1, 3}
        ends = [(e.get("data-src"), e.get("data-dst")) for e in elements_of if e.get("class") == "connector"]
        assert len(ends) == 4 and all({s, d} <= shapes_of for s, d in ends)
