"""Whole drawings: boxes placed with room between them, domains beside each other, connectors, and what overlaps.

A drawing is a structure's boxes: rows ``by, id, x, y, width, height`` with the centre at x, y; y grows downwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.functions import scalar
from helispan.operators import layout

#: Side of the squares by which boxes and lines are brought together.
CELL = 256.0
#: Boxes that touch up to rounding don't overlap.
TOUCH = 1e-6
_AWAY = {"LEFT": (-1, 0), "RIGHT": (1, 0), "ABOVE": (0, -1), "BELOW": (0, 1)}
#: Colours of connectors, in the order in which crossing ones take them.
LINE_COLOURS = scalar.COLOURS


def _edges(box: str) -> dict[str, Column]:
    x, y, w, h = (F.col(f"{box}.{c}") for c in ("x", "y", "width", "height"))
    return {"left": x - w / 2, "right": x + w / 2, "top": y - h / 2, "bottom": y + h / 2}


def _in_cells(rows: DataFrame, by: list[str], name: str, left: Column, right: Column, top: Column, bottom: Column) -> DataFrame:
    """``by, _cx, _cy, name`` for each square that a row's box reaches; ``name`` is the row with its edges."""
    d = rows.select(*by, F.struct(*[F.col(c) for c in rows.columns if c not in by], left.alias("_l"), right.alias("_r"), top.alias("_t"), bottom.alias("_b")).alias(name))
    at = lambda c: F.floor(F.col(f"{name}.{c}") / CELL)
    return d.withColumn("_cx", F.explode(F.sequence(at("_l"), at("_r")))).withColumn("_cy", F.explode(F.sequence(at("_t"), at("_b"))))


def _meeting(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rows whose boxes share a square and touch, once: in the square of their common box's upper left corner."""
    low_x, low_y = F.greatest("a._l", "b._l"), F.greatest("a._t", "b._t")
    both = a.join(b, [*by, "_cx", "_cy"]).where((F.floor(low_x / CELL) == F.col("_cx")) & (F.floor(low_y / CELL) == F.col("_cy")))
    return both.where((low_x <= F.least("a._r", "b._r")) & (low_y <= F.least("a._b", "b._b")))


def box_overlaps(placed: DataFrame, by: list[str]) -> DataFrame:
    """``by, a, b``: ids of boxes of a drawing that share an area, the lesser one first.

    Boxes are joined by the squares that they reach, so that only boxes near each other meet. Boxes without a place
    or size, and empty ones, overlap with nothing.
    """
    own = placed.select(*by, "id", "x", "y", "width", "height").where("x is not null and y is not null and width > 0 and height > 0")
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    a, b = (_in_cells(own, by, n, x - w / 2, x + w / 2, y - h / 2, y + h / 2) for n in "ab")
    shared = [F.least(f"a.{high}", f"b.{high}") - F.greatest(f"a.{low}", f"b.{low}") > TOUCH for low, high in (("_l", "_r"), ("_t", "_b"))]
    return _meeting(a, b, by).where((F.col("a.id") < F.col("b.id")) & shared[0] & shared[1]).select(*by, F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _turn(p: str, q: str, r: str) -> Column:
    """Sign of the turn from p by q to r; points are pairs of columns."""
    (ax, ay), (bx, by), (cx, cy) = (tuple(F.col(f"{s.split('.')[0]}.{k}{s.split('.')[1]}") for k in "xy") for s in (p, q, r))
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def line_crossings(lines: DataFrame, by: list[str]) -> DataFrame:
    """``by, a, b``: ids of lines of a drawing that cross, the lesser one first.

    ``lines`` has id, src, dst, x1, y1, x2, y2. Lines cross if they share a point, unless they begin or end at one element.
    """
    own = lines.select(*by, "id", "src", "dst", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    box = (F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"))
    a, b = (_in_cells(own, by, n, *box) for n in "ab")
    apart = ~(F.col("a.src").isin(F.col("b.src"), F.col("b.dst")) | F.col("a.dst").isin(F.col("b.src"), F.col("b.dst")))
    # On either line the ends of the other are not both on one side; boxes that touch settle lines on one line.
    across = (_turn("a.1", "a.2", "b.1") * _turn("a.1", "a.2", "b.2") <= 0) & (_turn("b.1", "b.2", "a.1") * _turn("b.1", "b.2", "a.2") <= 0)
    return _meeting(a, b, by).where((F.col("a.id") < F.col("b.id")) & apart & across).select(*by, F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def lines_through_boxes(lines: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """``by, line, box``: lines that pass through the inside of boxes which they neither leave nor enter."""
    own = lines.select(*by, "id", "src", "dst", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    a = _in_cells(own, by, "a", F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"))
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    b = _in_cells(placed.select(*by, "id", "x", "y", "width", "height"), by, "b", x - w / 2, x + w / 2, y - h / 2, y + h / 2)
    d = _meeting(a, b, by).where(~F.col("b.id").isin(F.col("a.src"), F.col("a.dst")))
    # The part of the line within the box's width, and within its height, as shares of its length.
    shares = []
    for k, low, high in (("x", "_l", "_r"), ("y", "_t", "_b")):
        start, step = F.col(f"a.{k}1"), F.col(f"a.{k}2") - F.col(f"a.{k}1")
        ends = [(F.col(f"b.{low}") + TOUCH - start) / step, (F.col(f"b.{high}") - TOUCH - start) / step]
        within = (start > F.col(f"b.{low}") + TOUCH) & (start < F.col(f"b.{high}") - TOUCH)
        shares.append((F.when(step == 0, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(*ends)), F.when(step == 0, F.when(within, 1.0).otherwise(-1.0)).otherwise(F.greatest(*ends))))
    first, last = F.greatest(F.lit(0.0), *[s[0] for s in shares]), F.least(F.lit(1.0), *[s[1] for s in shares])
    return d.where(first < last).select(*by, F.col("a.id").alias("line"), F.col("b.id").alias("box"))


def overlap_counts(placed: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """``by, boxes, crossings, covered, overlaps``: how many boxes overlap, lines cross and lines pass through boxes, and all of them."""
    found = [box_overlaps(placed, by).select(*by, F.lit("boxes").alias("what")), line_crossings(lines, by).select(*by, F.lit("crossings").alias("what")), lines_through_boxes(lines, placed, by).select(*by, F.lit("covered").alias("what"))]
    counts = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(*by).agg(*[F.count_if(F.col("what") == k).alias(k) for k in ("boxes", "crossings", "covered")])
    every = placed.select(*by).distinct().join(counts, by, "left").fillna(0, ["boxes", "crossings", "covered"])
    return every.withColumn("overlaps", F.col("boxes") + F.col("crossings") + F.col("covered"))


def _by_drawing(rows: DataFrame, by: list[str], make: Callable[[list[dict]], list[dict]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``by`` and the fields of the rows that ``make`` returns for the rows of each drawing; drawings go to Python many at once."""
    listed = rows.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in by])).alias("_rows"))
    kind = pa.list_(pa.struct([(name, t) for name, _, t in fields]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([make(own) for own in batch.column(len(by)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], out], names=[*by, "_made"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema]
    inner = ", ".join(f"{name}: {t}" for name, t, _ in fields)
    return listed.mapInArrow(made, ", ".join([*kinds, f"_made array<struct<{inner}>>"])).select(*by, F.inline("_made"))


def crossing_colours(lines: DataFrame, crossings: DataFrame, by: list[str], colours: list[str] = LINE_COLOURS) -> DataFrame:
    """``by, id, rank, colour``: each line the first colour that no crossing line of a lesser id has.

    Ranks tell crossing lines apart always; colours do as long as there are as many as ranks. Lines of one drawing are taken together.
    """
    def paint(own: list[dict]) -> list[dict]:
        before: dict[int, list[int]] = {}
        for r in own:
            if r["a"] is not None:
                before.setdefault(r["id"], []).append(r["a"])
        rank: dict[int, int] = {}
        for i in sorted(r["id"] for r in own if r["a"] is None):
            used = {rank[a] for a in before.get(i, [])}
            rank[i] = next(k for k in range(len(used) + 1) if k not in used)
        return [{"id": i, "rank": k, "colour": colours[k % len(colours)]} for i, k in rank.items()]

    rows = lines.select(*by, F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("a"))
    rows = rows.unionByName(crossings.select(*by, F.col("b").cast("long").alias("id"), F.col("a").cast("long").alias("a")))
    return _by_drawing(rows, by, paint, [("id", "long", pa.int64()), ("rank", "long", pa.int64()), ("colour", "string", pa.string())])


def line_colour(scheme: str, chain: Column, inter_domain: Column, colours: list[str] | None = None) -> Column:
    """Colour of a connector by a scheme (L7): ``all``, ``chain`` (by the chain's number) or ``domain`` (within and between domains).

    Without ``colours`` black is taken for all and within a domain, grey between domains, and LINE_COLOURS for chains.
    """
    if scheme == "chain":
        return scalar.palette(colours or LINE_COLOURS, chain)
    if scheme == "domain":
        inner, outer = colours or ["000000", "808080"]
        return F.when(inter_domain, outer).otherwise(inner)
    if scheme != "all":
        raise ValueError(f"no colour scheme {scheme}")
    return F.lit((colours or ["000000"])[0])


def aligned_connectors(placed: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by, src, dst, src_port, dst_port`` for helices that stand in order along the strands' axes.

    ``placed`` has id, kind, x, y, reversed, sideways, between (a helix between two strands of a sheet) and last (the
    last one of its chain). A connector enters strands at the end they begin at, helices between strands and last ones
    as the strand of their axis would be, and other helices on the side of the element before; it leaves an
    element on the side opposite to where the one before entered, or at the first element's end.
    """
    w = Window.partitionBy(*by).orderBy(order)
    strand, end = F.col("kind") == "strand", F.col("kind") == "terminus"
    helix = ~strand & ~end
    here = F.when(F.col("sideways"), F.col("x")).otherwise(F.col("y"))
    before = F.when(F.col("sideways"), F.lag("x").over(w)).otherwise(F.lag("y").over(w))
    nearer = helix & ~F.col("between") & ~F.col("last") & (before < here)
    top = F.when(strand | (helix & (F.col("between") | F.col("last"))), F.col("reversed")).otherwise(nearer)
    enters = F.when(end, "DEFAULT").when(top, F.when(F.col("sideways"), "LEFT").otherwise("TOP")).otherwise(F.when(F.col("sideways"), "RIGHT").otherwise("BOTTOM"))
    d = placed.withColumn("_before", F.lag("id").over(w)).withColumn("_in", F.when(F.col("_before").isNotNull(), enters)).withColumn("_nearer", nearer)
    first = F.lag("_in").over(w).isNull()
    below = F.when(first, F.lag(strand & F.col("reversed")).over(w)).otherwise(F.lag("_in").over(w).isin("TOP", "LEFT"))
    below = below | F.coalesce(F.col("_nearer"), F.lit(False))
    turned = F.lag("sideways").over(w)
    leaves = F.when(~end & F.lag(end).over(w), "DEFAULT").when(below, F.when(turned, "RIGHT").otherwise("BOTTOM")).otherwise(F.when(turned, "LEFT").otherwise("TOP"))
    out = d.select(*by, F.col("_before").alias("src"), F.col("id").alias("dst"), leaves.alias("src_port"), F.col("_in").alias("dst_port"))
    return out.where("src is not null")


def port_place(box: str, port: Column) -> tuple[Column, Column]:
    """Where a port is on a box, a structure column of x, y, width and height."""
    edge = _edges(box)
    x = F.when(port == "LEFT", edge["left"]).when(port == "RIGHT", edge["right"]).otherwise(F.col(f"{box}.x"))
    y = F.when(port == "TOP", edge["top"]).when(port == "BOTTOM", edge["bottom"]).otherwise(F.col(f"{box}.y"))
    return x, y


def lines_of(connectors: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """``by, id, src, dst, x1, y1, x2, y2, src_port, dst_port``: the connectors as lines between ports, numbered by their elements."""
    box = F.struct("x", "y", "width", "height")
    a, b = (placed.select(*by, F.col("id").alias(end), box.alias(f"_{end}")) for end in ("src", "dst"))
    d = connectors.join(a, [*by, "src"]).join(b, [*by, "dst"])
    (x1, y1), (x2, y2) = (port_place(f"_{end}", F.col(f"{end}_port")) for end in ("src", "dst"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("src", "dst"))
    return d.select(*by, number.cast("long").alias("id"), "src", "dst", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "src_port", "dst_port")


def axis_rooms(helices: DataFrame, sheets: DataFrame, by: list[str], gap: float = layout.GAP) -> DataFrame:
    """Adds ``x, y`` to helices drawn with a sheet (L5): on the axis of a strand above or below, or to the left or right of it.

    ``helices`` has sheet, side, column (of the strand's axis, for ABOVE and BELOW), order, width and height; ``sheets`` has
    sheet, left, right, top, bottom and left_column, the centre of the first column. Each axis and side is filled from
    the sheet outwards: a helix takes the room next to those that come before it in order, one gap further; one beside the sheet is centred.
    """
    upright = F.col("side").isin("ABOVE", "BELOW")
    lane = F.when(upright, F.col("column"))
    length = F.when(upright, F.col("height")).otherwise(F.col("width"))
    w = Window.partitionBy(*by, "sheet", "side", "_lane").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    d = helices.withColumn("_lane", lane).withColumn("_length", length)
    far = gap + F.coalesce(F.sum(F.col("_length") + gap).over(w), F.lit(0.0)) + F.col("_length") / 2
    d = d.withColumn("_far", far).join(sheets.select(*by, "sheet", F.struct("left", "right", "top", "bottom", "left_column").alias("_s")), [*by, "sheet"])
    on_axis = F.col("_s.left_column") + F.col("column") * layout.GAP
    middle_x, middle_y = (F.col("_s.left") + F.col("_s.right")) / 2, (F.col("_s.top") + F.col("_s.bottom")) / 2
    x = F.when(upright, on_axis).when(F.col("side") == "LEFT", F.col("_s.left") - F.col("_far")).when(F.col("side") == "RIGHT", F.col("_s.right") + F.col("_far")).otherwise(middle_x)
    y = F.when(F.col("side") == "ABOVE", F.col("_s.top") - F.col("_far")).when(F.col("side") == "BELOW", F.col("_s.bottom") + F.col("_far")).otherwise(middle_y)
    return d.select(*helices.columns, x.alias("x"), y.alias("y"))


class _Room:
    """Boxes already placed, searched for what a new box would hit."""

    def __init__(self, gap: float) -> None:
        self.gap = gap
        self.boxes: dict[int, tuple[float, float, float, float]] = {}

    def hit(self, x: float, y: float, w: float, h: float) -> int | None:
        """The first placed box nearer than a gap to the given one."""
        for i, (bx, by, bw, bh) in self.boxes.items():
            if abs(x - bx) < (w + bw) / 2 + self.gap - TOUCH and abs(y - by) < (h + bh) / 2 + self.gap - TOUCH:
                return i
        return None

    def beside(self, other: int, position: str, w: float, h: float) -> tuple[float, float]:
        dx, dy = _AWAY[position]
        x, y, ow, oh = self.boxes[other]
        return x + dx * ((ow + w) / 2 + self.gap), y + dy * ((oh + h) / 2 + self.gap)

    def beyond(self, x: float, y: float, w: float, h: float, position: str) -> tuple[float, float]:
        """The first free place in a direction: each box that is hit is passed on its far side."""
        while (i := self.hit(x, y, w, h)) is not None:
            at = self.beside(i, position, w, h)
            x, y = (at[0], y) if position in ("LEFT", "RIGHT") else (x, at[1])
        return x, y


#: Drawings of up to so many boxes are placed many at once, and so many pairs of boxes go into a block of them.
TOGETHER, BLOCK = 128, 1 << 20
_SIDES = list(_AWAY)
_STEPS = np.array(list(_AWAY.values()), dtype=np.float64)
_PLACED = [("id", "long", pa.int64()), ("step", "long", pa.int64()), ("reference", "long", pa.int64()), ("position", "string", pa.string()), ("x", "double", pa.float64()), ("y", "double", pa.float64())]


def _place_alone(own: list[tuple[int, bool, float, float]], near: list[tuple[float, int, int, str]], gap: float) -> list[tuple]:
    """Rows of ``_PLACED`` of one drawing: boxes id, sheet, width and height, and pairs dist, ref, test and position."""
    own = sorted(own, key=lambda r: (not r[1], -r[2] * r[3], r[0]))
    size = {i: (w, h) for i, _, w, h in own}
    towards: dict[tuple[int, int], str] = {}
    of: dict[int, list[tuple[float, int, int, str]]] = {}
    for d, r, t, p in sorted(near, key=lambda x: x[:3]):
        if r in size and t in size and r != t and (r, t) not in towards:
            towards[r, t] = p
            of.setdefault(r, []).append((d, r, t, p))
    room, rows, heap = _Room(gap), [], []

    def put(node: int, at: tuple[float, float], origin: int | None, position: str | None) -> None:
        room.boxes[node] = (*at, *size[node])
        rows.append((node, len(rows), origin, position, *at))
        for x in of.get(node, []):
            heapq.heappush(heap, x)

    def search(origin: int, node: int, position: str) -> tuple[tuple[float, float], int, str]:
        at = room.beside(origin, position, *size[node])
        taken = room.hit(*at, *size[node])
        if taken is None:
            return at, origin, position
        if (taken, node) in towards:
            other = towards[taken, node]
            at = room.beside(taken, other, *size[node])
            if room.hit(*at, *size[node]) is None:
                return at, taken, other
        for other in layout.FREE_SLOTS:
            at = room.beside(origin, other, *size[node])
            if room.hit(*at, *size[node]) is None:
                return at, origin, other
        return room.beyond(*room.beside(origin, position, *size[node]), *size[node], position), origin, position

    for node in size:
        if node in room.boxes:
            continue
        if not room.boxes:
            put(node, (0.0, 0.0), None, None)
        else:
            right = max(x + w / 2 for x, _, w, _ in room.boxes.values())
            put(node, (right + gap + size[node][0] / 2, 0.0), None, None)
        while heap:
            _, origin, test, position = heapq.heappop(heap)
            if test not in room.boxes:
                at, origin, position = search(origin, test, position)
                put(test, at, origin, position)
    return rows


def _place_together(w: np.ndarray, h: np.ndarray, seed: np.ndarray, dist: np.ndarray, side: np.ndarray, gap: float) -> tuple[np.ndarray, ...]:
    """What ``_place_alone`` does, for many drawings of n boxes each, box by box of all of them.

    Given are sizes and ranks as seeds, one row for each drawing with boxes in order of their ids, and dist and side (-1: no
    pair) of each box (second axis) to each (third). Returned are, by step, the boxes, their references, sides (-1: none) and places.
    """
    count, n = w.shape
    every = np.arange(count)
    x, y, step, done = np.zeros((count, n)), np.zeros((count, n)), np.full((count, n), n), np.zeros((count, n), bool)
    # The nearest placed box of each one that is not placed.
    near, of = np.full((count, n), np.inf), np.full((count, n), n)
    out = tuple(np.empty((count, n), t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64))

    def beside(g: np.ndarray, other: np.ndarray, position: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = _STEPS[position].T
        return x[g, other] + dx * ((w[g, other] + w[g, test]) / 2 + gap), y[g, other] + dy * ((h[g, other] + h[g, test]) / 2 + gap)

    def hit(g: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, test: np.ndarray) -> np.ndarray:
        """The box placed first of those in the way, n where there is room."""
        close = done[g] & (np.abs(at_x[:, None] - x[g]) < (w[g, test][:, None] + w[g]) / 2 + gap - TOUCH) & (np.abs(at_y[:, None] - y[g]) < (h[g, test][:, None] + h[g]) / 2 + gap - TOUCH)
        return np.where(close.any(axis=1), np.where(close, step[g], n).argmin(axis=1), n)

    for k in range(n):
        least = near.min(axis=1)
        some = least < np.inf
        tied = near == least[:, None]
        first = np.where(tied, of, n).min(axis=1)
        test = np.where(some, (tied & (of == first[:, None])).argmax(axis=1), np.where(done, n, seed).argmin(axis=1))
        origin, position = np.where(some, first, -1), np.full(count, -1)
        at_x, at_y = np.zeros(count), np.zeros(count)
        if k:
            at_x = np.where(done, x + w / 2, -np.inf).max(axis=1) + gap + w[every, test] / 2
        g = np.flatnonzero(some)
        if len(g):
            t, o = test[g], origin[g]
            p = side[g, o, t]
            position[g] = p
            at_x[g], at_y[g] = start_x, start_y = beside(g, o, p, t)
            taken = hit(g, start_x, start_y, t)
            left = np.flatnonzero(taken < n)

            def tried(left: np.ndarray, other: np.ndarray, sides: np.ndarray) -> np.ndarray:
                """Puts those that find room beside the others given, and returns which are left."""
                rows = g[left]
                nx, ny = beside(rows, other, sides, t[left])
                free = hit(rows, nx, ny, t[left]) == n
                found = rows[free]
                at_x[found], at_y[found], origin[found], position[found] = nx[free], ny[free], other[free], sides[free]
                return left[~free]

            if len(left):
                other = side[g[left], taken[left], t[left]]
                known = other >= 0
                left = np.sort(np.concatenate([left[~known], tried(left[known], taken[left[known]], other[known])]))
            for slot in layout.FREE_SLOTS:
                if len(left):
                    left = tried(left, o[left], np.full(len(left), _SIDES.index(slot)))
            px, py = start_x[left], start_y[left]
            lying = p[left] < 2
            going = np.arange(len(left))
            while len(going):
                rows, tests = g[left[going]], t[left[going]]
                taken = hit(rows, px[going], py[going], tests)
                on = taken < n
                going, rows, tests, taken = going[on], rows[on], tests[on], taken[on]
                nx, ny = beside(rows, taken, p[left[going]], tests)
                px[going], py[going] = np.where(lying[going], nx, px[going]), np.where(lying[going], py[going], ny)
            at_x[g[left]], at_y[g[left]] = px, py
        x[every, test], y[every, test], step[every, test], done[every, test] = at_x, at_y, k, True
        for o, v in zip(out, (test, origin, position, at_x, at_y), strict=True):
            o[:, k] = v
        new = dist[every, test]
        closer = (side[every, test] >= 0) & ((new < near) | ((new == near) & (test[:, None] < of)))
        near, of = np.where(closer, new, near), np.where(closer, test[:, None], of)
        near[done] = np.inf
    return out


def _filled(column: pa.Array, what: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"a box without {what}")
    return column.to_numpy(zero_copy_only=False)


def _placed(drawings: pa.Array, boxes: pa.ListArray, near: pa.ListArray, gap: float) -> pa.RecordBatch:
    """``_d`` (of ``drawings``) and the fields of ``_PLACED`` for the boxes of each drawing."""
    e, p = boxes.flatten(), near.flatten()
    sizes = lambda a: np.where(a.is_null().to_numpy(zero_copy_only=False), 0, np.diff(a.offsets.to_numpy()))
    own, of = (np.repeat(np.arange(len(drawings)), sizes(a)) for a in (boxes, near))
    ids, w, h = (_filled(e.field(c), c) for c in ("id", "width", "height"))
    sheet = np.asarray(pc.fill_null(pc.equal(e.field("kind"), "sheet"), False).to_numpy(zero_copy_only=False), bool)
    whole = np.logical_and.reduce([p.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("ref", "test", "dist", "position")])
    p, of = p.filter(pa.array(whole)), of[whole]
    ref, test, dist = (p.field(c).to_numpy(zero_copy_only=False) for c in ("ref", "test", "dist"))
    side = pc.index_in(p.field("position"), pa.array(_SIDES))
    if side.null_count:
        raise ValueError(f"a position that is none of {', '.join(_SIDES)}")
    side = side.to_numpy(zero_copy_only=False)

    # Boxes by drawing and id; of a repeated id the largest one decides when it comes and the smallest one its size.
    order = np.lexsort((-(w * h), ~sheet, ids, own))
    own, ids, w, h, sheet = (c[order] for c in (own, ids, w, h, sheet))
    first = np.ones(len(ids), bool)
    first[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
    area, last = (w * h)[first], np.roll(first, -1)
    own, ids, w, h, sheet = own[first], ids[first], w[last], h[last], sheet[first]
    starts = np.searchsorted(own, np.arange(len(drawings) + 1))
    counts = np.diff(starts)
    seed = np.empty(len(ids), np.int64)
    seed[np.lexsort((ids, -area, ~sheet, own))] = np.arange(len(ids))
    names, number = np.unique(np.concatenate([ids, ref, test]), return_inverse=True)
    key = own * len(names) + number[: len(ids)]

    def found(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(key, of * len(names) + numbers), max(len(key) - 1, 0))
        return at, (key[at] == of * len(names) + numbers) if len(key) else np.zeros(len(of), bool)

    (a, known), (b, too) = (found(number[len(ids) + i * len(ref) : len(ids) + (i + 1) * len(ref)]) for i in range(2))
    some = known & too & (a != b)
    # Of pairs given twice the nearer one is written last and stays; what is no number comes after all.
    far = np.finfo(np.float64).max
    dist = np.where(np.isnan(dist), far, np.minimum(dist, far))[some]
    nearer = np.argsort(dist, kind="stable")[::-1]
    a, b, dist, side, of = a[some][nearer], b[some][nearer], dist[nearer], side[some][nearer], of[some][nearer]
    by_drawing = np.argsort(of, kind="stable")
    a, b, dist, side = (c[by_drawing] for c in (a, b, dist, side))
    pair_starts = np.searchsorted(of[by_drawing], np.arange(len(drawings) + 1))

    def within(starts: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows of drawings ``g``, and the place in ``g`` of each."""
        lengths = starts[g + 1] - starts[g]
        at = np.repeat(np.arange(len(g)), lengths)
        return np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[g][at], at

    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for n in np.unique(counts[counts > 0]).tolist():
        every = np.flatnonzero(counts == n)
        if n > TOGETHER:
            for d in every.tolist():
                i, j = slice(starts[d], starts[d + 1]), slice(pair_starts[d], pair_starts[d + 1])
                pairs = zip(dist[j].tolist(), ids[a[j]].tolist(), ids[b[j]].tolist(), [_SIDES[s] for s in side[j]], strict=True)
                rows = list(zip(*_place_alone(list(zip(ids[i].tolist(), sheet[i].tolist(), w[i].tolist(), h[i].tolist(), strict=True)), list(pairs), gap), strict=True))
                at = {v: k for k, v in enumerate(ids[i].tolist(), starts[d])}
                both = [[at.get(v, -1) for v in rows[c]] for c in (0, 2)]
                sides = [-1 if s is None else _SIDES.index(s) for s in rows[3]]
                for c, v in zip(columns, (np.full(n, d), both[0], rows[1], both[1], sides, rows[4], rows[5]), strict=True):
                    c.append(np.asarray(v))
            continue
        block = max(1, BLOCK // (n * n))
        for cut in range(0, len(every), block):
            g = every[cut : cut + block]
            i, j = starts[g][:, None] + np.arange(n), within(pair_starts, g)
            cell = (j[1], a[j[0]] - starts[g][j[1]], b[j[0]] - starts[g][j[1]])
            to, sides = np.full((len(g), n, n), np.inf), np.full((len(g), n, n), -1)
            to[cell], sides[cell] = dist[j[0]], side[j[0]]
            rank = seed[i].argsort(axis=1).argsort(axis=1)
            node, origin, position, x, y = _place_together(w[i], h[i], rank, to, sides, gap)
            base = starts[g][:, None]
            made = (np.repeat(g, n), node + base, np.tile(np.arange(n), len(g)), np.where(origin < 0, -1, origin + base), position, x, y)
            for c, v in zip(columns, made, strict=True):
                c.append(v.ravel())
    d, node, step, origin, position, x, y = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, (np.int64,) * 5 + (np.float64,) * 2, strict=True))
    none = origin < 0
    reference = pa.array(ids[origin] if len(ids) else origin, pa.int64(), mask=none)
    position = pa.array(_SIDES).take(pa.array(position, pa.int32(), mask=none))
    return pa.RecordBatch.from_arrays([drawings.take(pa.array(d)), pa.array(ids[node] if len(ids) else node, pa.int64()), pa.array(step, pa.int64()), reference, position, pa.array(x), pa.array(y)], names=["_d", *(f[0] for f in _PLACED)])


def place_listed(drawings: DataFrame, by: list[str], gap: float = layout.GAP) -> DataFrame:
    """What ``place_boxes`` gives, for a row for each drawing: by, elements (an array of id, kind, width, height) and pairs (of ref, test, dist, position)."""
    key = F.struct(*by)
    near = "array<struct<ref:bigint,test:bigint,dist:double,position:string>>"
    rows = drawings.select(key.alias("_d"), F.col("elements").cast("array<struct<id:bigint,kind:string,width:double,height:double>>").alias("_e"), F.coalesce(F.col("pairs").cast(near), F.array().cast(near)).alias("_p"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _placed(*batch.columns, gap)

    fields = ", ".join(f"{name} {t}" for name, t, _ in _PLACED)
    return rows.mapInArrow(made, f"_d {rows.schema['_d'].dataType.simpleString()}, {fields}").select("_d.*", *[f[0] for f in _PLACED])


def place_boxes(elements: DataFrame, pairs: DataFrame, by: list[str], gap: float = layout.GAP) -> DataFrame:
    """``by, id, step, reference, position, x, y``: centres of boxes, no two nearer than a gap.

    ``elements`` has id, kind, width and height; ``pairs`` has, in both directions, ref, test, dist and position, rows with nulls are ignored. The largest sheet
    is the seed at 0, 0, or the largest box; then comes the element nearest to any placed one, beside it. Where
    another box is in the way, the same is tried beside that one, once, then the free sides of the reference; at last the
    element goes on in its direction until there is room. Of equals the least id comes first. Elements that no pair connects with
    placed ones follow to the right of all.
    """
    own, near = F.struct("id", "kind", "width", "height"), F.struct("ref", "test", "dist", "position")
    rows = elements.select(*by, own.alias("_e"), F.lit(None).alias("_p")).unionByName(pairs.select(*by, F.lit(None).alias("_e"), near.alias("_p")))
    return place_listed(rows.groupBy(*by).agg(F.collect_list("_e").alias("elements"), F.collect_list("_p").alias("pairs")), by, gap)


def place_domains(placed: DataFrame, pairs: DataFrame, by: list[str], domain: str = "domain", gap: float = layout.DOMAIN_GAP) -> DataFrame:
    """``placed`` with the boxes of each domain moved as a whole, so that domains stand beside each other.

    ``pairs`` has ref, test (numbers of domains, in both directions), dist and position; the same placement as for
    elements puts the domains' boxes, a domain gap apart.
    """
    edges = {"left": F.min(F.col("x") - F.col("width") / 2), "right": F.max(F.col("x") + F.col("width") / 2), "top": F.min(F.col("y") - F.col("height") / 2), "bottom": F.max(F.col("y") + F.col("height") / 2)}
    boxes = placed.groupBy(*by, domain).agg(*[c.alias(n) for n, c in edges.items()])
    sizes = boxes.select(*by, F.col(domain).alias("id"), F.lit("domain").alias("kind"), (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))
    at = place_boxes(sizes, pairs, by, gap).select(*by, F.col("id").alias(domain), F.col("x").alias("_x"), F.col("y").alias("_y"))
    shift = boxes.join(at, [*by, domain]).select(*by, domain, (F.col("_x") - (F.col("left") + F.col("right")) / 2).alias("_dx"), (F.col("_y") - (F.col("top") + F.col("bottom")) / 2).alias("_dy"))
    moved = layout.moved(placed.join(shift, [*by, domain]), F.col("_dx"), F.col("_dy"))
    return moved.select(*placed.columns)
