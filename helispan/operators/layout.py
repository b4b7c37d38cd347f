"""Drawing a structure: relative positions, coordinates, connectors, colours and assembly.

The rules are column expressions over rows of a reference and a test element; only the placement
loop, whose state is local to one structure, holds a structure in a group. Coordinates are centres,
y grows downwards.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.functions import scalar

#: Gap and separation of elements, lengths for each residue, widths, gaps of sheets, termini and domains.
GAP, STRAND_LENGTH, HELIX_LENGTH, HELIX_WIDTH, STRAND_WIDTH, SHEET_GAP, TERMINUS, DOMAIN_GAP, SCALE = 55.0, 21.0, 10.0, 30.0, 40.0, 90.0, 32.0, 50.0, 1.6
#: Share by which one of two distances has to be larger to tell an end of a strand from the other.
SIGNIFICANT = 0.15
TURNED = {"ABOVE": "LEFT", "BELOW": "RIGHT", "LEFT": "ABOVE", "RIGHT": "BELOW"}
FREE_SLOTS = ["LEFT", "RIGHT", "ABOVE", "BELOW"]
_STEP = {"ABOVE": (0, -1), "BELOW": (0, 1), "LEFT": (-1, 0), "RIGHT": (1, 0)}


def _sideways(position: Column, sideways: Column) -> Column:
    turned = F.create_map(*[F.lit(x) for pair in TURNED.items() for x in pair])
    return F.when(sideways, F.element_at(turned, position)).otherwise(position)


def helix_by_helix(reference_top: Column, test_top: Column, sideways: Column) -> Column:
    """A helix beside a helix: above if the reference's nearest residue is at its top and the test's is not (L2)."""
    return _sideways(F.when(reference_top & ~test_top, "ABOVE").otherwise("BELOW"), sideways)


def helix_by_sheet(first: Column, last: Column, reference_top: Column, test_top: Column, sideways: Column) -> Column:
    """A helix beside a sheet whose nearest strand is the first, the last or an inner one (L2)."""
    inner = helix_by_helix(reference_top, test_top, F.lit(False))
    return _sideways(F.when(first, "RIGHT").when(last, "LEFT").otherwise(inner), sideways)


def sheet_by_helix(first: Column, last: Column, near_top: Column, sideways: Column) -> Column:
    """A sheet beside a helix, by the sheet's strand that is nearest to it (L2)."""
    return _sideways(F.when(first, "LEFT").when(last, "RIGHT").when(near_top, "ABOVE").otherwise("BELOW"), sideways)


def sheet_by_sheet(reference_edge: Column, test_edge: Column, crossing: Column, to_n: Column, to_c: Column, reference_reversed: Column) -> Column:
    """``position, turn`` of a sheet beside a sheet (L2).

    Edges are ``first``, ``last`` or null for inner strands. Two edges that do not cross are neighbours,
    and the test sheet's order is turned if they are edges of the same name. Otherwise the test's central
    residue is nearer to the upper or lower end of the reference's longest strand, if its distances
    ``to_n`` and ``to_c`` to the ends differ enough.
    """
    edges = reference_edge.isNotNull() & test_edge.isNotNull() & ~crossing
    clear = F.abs(to_n - to_c) > SIGNIFICANT * F.least(to_n, to_c)
    near_top = (to_c < to_n) != reference_reversed
    position = F.when(edges, F.when(reference_edge == "first", "LEFT").otherwise("RIGHT")).when(clear & near_top, "ABOVE").otherwise("BELOW")
    return F.struct(position.alias("position"), (edges & (reference_edge == test_edge)).alias("turn"))


def drawn_direction(code: Column, default: str, reference_sideways: Column, reference_reversed: Column) -> Column:
    """``sideways, reversed`` of an element from its code towards the reference, or from ``default`` without one (L2).

    O and H point against the reference, P and K with it; L and R turn the element sideways, R against
    and L with the reference's direction.
    """
    letter = F.substring(F.coalesce(F.when(code != "??", code), F.lit(default)), 1, 1)
    crossing = letter.isin("L", "R")
    turned = F.when(crossing, (letter == "R") != reference_reversed).otherwise(letter.isin("O", "H") != reference_reversed)
    return F.struct((crossing != reference_sideways).alias("sideways"), turned.alias("reversed"))


def beside_sheet(place: Column, columns: Column, sideways: Column) -> Column:
    """Where a helix between two strands of one sheet on the same axis goes (L5): beside the nearer half."""
    return _sideways(F.when(place >= columns / 2, "RIGHT").otherwise("LEFT"), sideways)


def extent(kind: Column, span: Column) -> Column:
    """``width, height`` of an element of so many residues (L3, L4)."""
    height = F.when(kind == "strand", span * STRAND_LENGTH).when(kind == "terminus", F.lit(TERMINUS)).otherwise(span * HELIX_LENGTH)
    width = F.when(kind == "strand", F.lit(STRAND_WIDTH)).when(kind == "terminus", F.lit(TERMINUS)).otherwise(F.lit(HELIX_WIDTH))
    return F.struct(width.alias("width"), height.cast("double").alias("height"))


def beside(position: Column, x: Column, y: Column, width: Column, height: Column, own_width: Column, own_height: Column, gap: Column | float = GAP) -> Column:
    """``x, y`` of an element at a position beside another (L3)."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    across, along = (width + own_width) / 2 + gap, (height + own_height) / 2 + gap
    dx = F.when(position == "LEFT", -across).when(position == "RIGHT", across).otherwise(0.0)
    dy = F.when(position == "ABOVE", -along).when(position == "BELOW", along).otherwise(0.0)
    return F.struct((x + dx).alias("x"), (y + dy).alias("y"))


def strand_places(strands: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``x, y, width, height`` to the strands of sheets, from place, offset, lo and hi (L4).

    Columns are one gap apart from the first; heights are residues times a strand's length, and a strand's
    offset moves its upper end.
    """
    d = strands.withColumn("_size", extent(F.lit("strand"), F.col("hi") - F.col("lo") + 1))
    x = F.col("place") * GAP
    y = F.col("offset") * STRAND_LENGTH + F.col("_size.height") / 2
    return d.select(*strands.columns, x.alias("x"), y.alias("y"), "_size.width", "_size.height")


def terminus(lo: Column, hi: Column, chain_lo: Column, chain_hi: Column, whole: Column, domain: Column, chain: Column) -> Column:
    """``nterm, cterm``: labels of a chain's ends in a domain (L6); ends inside the chain are lower case with domain and chain."""
    suffix = F.concat(domain.cast("string"), chain)
    return F.struct(F.when(whole | (lo <= chain_lo), "N").otherwise(F.concat(F.lit("n"), suffix)).alias("nterm"), F.when(whole | (hi >= chain_hi), "C").otherwise(F.concat(F.lit("c"), suffix)).alias("cterm"))


def terminus_place(x: Column, y: Column, height: Column, is_reversed: Column, first: Column) -> Column:
    """``x, y`` of a terminus one gap beyond the visible element next to it, on the side its chain comes from or goes to."""
    below = first != is_reversed
    distance = height / 2 + GAP
    return F.struct(x.alias("x"), (y + F.when(below, distance).otherwise(-distance)).alias("y"))


def port(leaves: Column, is_reversed: Column, sideways: Column, is_terminus: Column) -> Column:
    """Side of an element where a connector leaves or enters it."""
    top = leaves != is_reversed
    plain = F.when(top, F.when(sideways, "LEFT").otherwise("TOP")).otherwise(F.when(sideways, "RIGHT").otherwise("BOTTOM"))
    return F.when(is_terminus, "DEFAULT").otherwise(plain)


def connectors(placed: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by, src, dst, src_port, dst_port``: elements that follow each other in a chain.

    ``placed`` has id, reversed, sideways and kind.
    """
    w = Window.partitionBy(*by).orderBy(order)
    here = F.struct("id", "reversed", "sideways", (F.col("kind") == "terminus").alias("end"))
    d = placed.select(*by, here.alias("b"), F.lag(here).over(w).alias("a")).where("a is not null")
    ports = [port(F.lit(leaves), F.col(f"{s}.reversed"), F.col(f"{s}.sideways"), F.col(f"{s}.end")) for leaves, s in ((True, "a"), (False, "b"))]
    return d.select(*by, F.col("a.id").alias("src"), F.col("b.id").alias("dst"), ports[0].alias("src_port"), ports[1].alias("dst_port"))


def across_domains(elements: DataFrame, by: list[str], order: str, domain: str) -> DataFrame:
    """``by, src, dst, from, to``: the connectors that pass from one domain to another."""
    w = Window.partitionBy(*by).orderBy(order)
    d = elements.select(*by, F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), F.lag(domain).over(w).alias("from"), F.col(domain).alias("to"))
    return d.where(F.col("from") != F.col("to"))


def node_colours(elements: DataFrame, by: list[str], order: str, scheme: str) -> DataFrame:
    """Adds ``colour`` by a scheme (L8, L9): none, simple (by kind), gradient (along the chain) or sheet (a colour each).

    ``elements`` has kind and sheet; null sheets stay white.
    """
    if scheme == "none":
        return elements.withColumn("colour", F.lit("ffffff"))
    if scheme == "simple":
        return elements.withColumn("colour", F.when(F.col("kind") == "strand", "ffff00").when(F.col("kind") == "alpha", "ff0000").otherwise("ffffff"))
    if scheme == "gradient":
        w = Window.partitionBy(*by)
        rank, count = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
        return elements.withColumn("_r", rank).withColumn("_n", count).withColumn("colour", scalar.gradient(F.col("_r"), F.col("_n"))).drop("_r", "_n")
    if scheme != "sheet":
        raise ValueError(f"no colour scheme {scheme}")
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("sheet").asc_nulls_last())) - 1
    return elements.withColumn("_r", rank).withColumn("colour", F.when(F.col("sheet").isNull(), "ffffff").otherwise(scalar.palette(scalar.COLOURS, F.col("_r")))).drop("_r")


def listed_colours(elements: DataFrame, by: list[str], order: str, colours: dict[str, list[str]], default: str = "ffffff") -> DataFrame:
    """Adds ``colour`` from lists of colours by kind (L9): elements of a kind take its colours in turn, in their order.

    Strands of a sheet share a colour of the list ``sheet``, sheets taking it in turn; kinds without a list, and strands without
    a sheet, get the default.
    """
    rank = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(order)) - 1
    sheet = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("sheet").asc_nulls_last())) - 1
    d = elements.withColumn("_r", rank).withColumn("_s", sheet)
    colour = F.lit(default)
    for kind, own in colours.items():
        if kind != "sheet":
            colour = F.when(F.col("kind") == kind, scalar.palette(own, F.col("_r"))).otherwise(colour)
    if "sheet" in colours:
        colour = F.when((F.col("kind") == "strand") & F.col("sheet").isNotNull(), scalar.palette(colours["sheet"], F.col("_s"))).otherwise(colour)
    return d.withColumn("colour", colour).drop("_r", "_s")


def fold_colours(elements: DataFrame, by: list[str], order: str, default: str = "ffffff") -> DataFrame:
    """Adds ``part`` and ``colour`` by the scheme ``fold`` (L9, G12): strands of a sheet that follow each other with only turns between share both.

    Parts are numbered from 0 in order; elements that are no strands of a sheet have none, and the default colour.
    """
    w = Window.partitionBy(*by).orderBy(order)
    strand = (F.col("kind") == "strand") & F.col("sheet").isNotNull()
    goes_on = F.coalesce(F.lag(strand).over(w) & (F.lag("sheet").over(w) == F.col("sheet")), F.lit(False))
    d = elements.withColumn("_b", (strand & ~goes_on).cast("int")).withColumn("part", F.when(strand, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)).drop("_b")
    return d.withColumn("colour", F.when(F.col("part").isNull(), default).otherwise(scalar.palette(scalar.COLOURS, F.col("part"))))


def flipped(strands: DataFrame, by: list[str]) -> DataFrame:
    """A sheet seen from behind: its columns in the opposite order."""
    last = F.max("place").over(Window.partitionBy(*by))
    return strands.withColumn("place", last - F.col("place"))


def turned_over(strands: DataFrame, by: list[str]) -> DataFrame:
    """A sheet upside down: directions change, and offsets count from the other end."""
    reach = F.max(F.col("offset") + F.col("hi") - F.col("lo") + 1).over(Window.partitionBy(*by))
    return strands.withColumn("_reach", reach).withColumn("offset", F.col("_reach") - F.col("offset") - (F.col("hi") - F.col("lo") + 1)).withColumn("reversed", ~F.col("reversed")).drop("_reach")


def laid_sideways(placed: DataFrame) -> DataFrame:
    """Elements turned by a right angle: x and y, widths and heights change places."""
    return placed.withColumns({"x": F.col("y"), "y": F.col("x"), "width": F.col("height"), "height": F.col("width"), "sideways": ~F.col("sideways")})


def moved(placed: DataFrame, dx: Column | float, dy: Column | float) -> DataFrame:
    """Elements moved."""
    return placed.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def scaled(placed: DataFrame, factor: float = SCALE) -> DataFrame:
    """Coordinates, not sizes, multiplied."""
    return placed.withColumns({"x": F.col("x") * factor, "y": F.col("y") * factor})


def bounds(placed: DataFrame, by: list[str]) -> DataFrame:
    """``by, left, top, right, bottom``: the box of all elements, with a whole width and height around each centre."""
    ends = {"left": F.min(F.col("x") - F.col("width")), "top": F.min(F.col("y") - F.col("height")), "right": F.max(F.col("x") + F.col("width")), "bottom": F.max(F.col("y") + F.col("height"))}
    return placed.groupBy(*by).agg(*[c.alias(n) for n, c in ends.items()])


def domain_shift(reference: Column, test: Column, position: Column) -> Column:
    """``dx, dy`` that bring a domain's box beside the box of a placed one, a domain gap apart."""
    dx = F.when(position == "LEFT", reference["left"] - DOMAIN_GAP - test["right"]).when(position == "RIGHT", reference["right"] + DOMAIN_GAP - test["left"]).otherwise(reference["left"] - test["left"])
    dy = F.when(position == "ABOVE", reference["top"] - DOMAIN_GAP - test["bottom"]).when(position == "BELOW", reference["bottom"] + DOMAIN_GAP - test["top"]).otherwise(reference["top"] - test["top"])
    return F.struct(dx.alias("dx"), dy.alias("dy"))


def place_elements(elements: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by, id, step, reference, position, column, row``: the placement loop on a grid, for each structure.

    ``elements`` has id, kind and size; ``pairs`` has, in both directions, ref, test, dist and position.
    The largest sheet is the seed, or the largest element; then comes the element nearest to any placed
    one, beside it. If that slot is taken, the same is tried beside its occupant, once; then the first
    free slot of west, east, north, south. Of equals the least id comes first. Elements that no pair
    connects with the placed ones follow east of the last column.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in elements.select(*by).schema)

    def place(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(rest=own.kind != "sheet").sort_values(["rest", "size", "id"], ascending=[True, False, True])
        near = near.sort_values(["dist", "ref", "test"])
        asked = list(zip(near.ref.tolist(), near.test.tolist(), near.position.tolist(), strict=True))
        towards = {(r, t): p for r, t, p in asked}
        # The pairs of placed elements, by their place in the order of all.
        of: dict[int, list[int]] = {}
        for k, (r, _, _) in enumerate(asked):
            of.setdefault(r, []).append(k)
        heap: list[int] = []
        at: dict[int, tuple[int, int]] = {}
        taken: dict[tuple[int, int], int] = {}
        rows = []

        def put(node: int, slot: tuple[int, int], origin: int | None, position: str | None) -> None:
            at[node], taken[slot] = slot, node
            rows.append((*key, node, len(rows), origin, position, *slot))
            for k in of.get(node, []):
                heapq.heappush(heap, k)

        def slot_beside(node: int, position: str) -> tuple[int, int]:
            return at[node][0] + _STEP[position][0], at[node][1] + _STEP[position][1]

        ids = own.id.tolist()
        while len(at) < len(ids):
            if not at:
                put(ids[0], (0, 0), None, None)
                continue
            while heap and asked[heap[0]][1] in at:
                heapq.heappop(heap)
            found = asked[heapq.heappop(heap)] if heap else None
            if found is None:
                put(next(i for i in ids if i not in at), (max(c for c, _ in taken) + 1, 0), None, None)
                continue
            origin, node, position = found
            slot = slot_beside(origin, position)
            if slot in taken and (taken[slot], node) in towards:
                origin, position = taken[slot], towards[taken[slot], node]
                slot = slot_beside(origin, position)
            if slot in taken:
                free = [p for p in FREE_SLOTS if slot_beside(origin, p) not in taken]
                if free:
                    position = free[0]
                    slot = slot_beside(origin, position)
                else:
                    origin, position, slot = None, None, (max(c for c, _ in taken) + 1, 0)
            put(node, slot, origin, position)
        return pd.DataFrame(rows, columns=[*by, "id", "step", "reference", "position", "column", "row"])

    left = elements.select(*by, F.col("id").cast("long"), "kind", F.col("size").cast("double"))
    right = pairs.select(*by, F.col("ref").cast("long"), F.col("test").cast("long"), F.col("dist").cast("double"), "position")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(place, f"{fields}, id long, step long, reference long, position string, column long, row long")


def helix_clusters(helices: DataFrame, distances: DataFrame, by: list[str], limit: float = 7.0) -> DataFrame:
    """``by, id, cluster``: helices in order, each in the first group whose members are all nearer than ``limit``."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in helices.select(*by).schema)

    def group(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        close = {tuple(sorted(p)) for p, d in zip(zip(near.src, near.dst, strict=True), near.dist, strict=True) if d < limit}
        groups: list[list[int]] = []
        for i in sorted(own.id.tolist()):
            home = next((g for g in groups if all((m, i) in close for m in g)), None)
            groups.append([i]) if home is None else home.append(i)
        return pd.DataFrame([(*key, i, k) for k, g in enumerate(groups) for i in g], columns=[*by, "id", "cluster"])

    return helices.select(*by, F.col("id").cast("long")).groupBy(*by).cogroup(distances.select(*by, F.col("src").cast("long"), F.col("dst").cast("long"), F.col("dist").cast("double")).groupBy(*by)).applyInPandas(group, f"{fields}, id long, cluster long")


def nearer_strand(before: Column, after: Column, gap_before: Column, gap_after: Column, used_before: Column, used_after: Column) -> Column:
    """Which of two strands a helix between them is drawn with (L5): before, after or null.

    The only one there is; else the one whose axis leaves no gap in the sheet; else the one whose axis
    has no helix yet; else the nearer one by elements between, the first on a tie (``before`` and
    ``after`` are those numbers, null without a strand).
    """
    one = F.when(before.isNull() & after.isNull(), F.lit(None)).when(before.isNull(), "after").when(after.isNull(), "before")
    return one.when(gap_before != gap_after, F.when(gap_before, "after").otherwise("before")).when(used_before != used_after, F.when(used_before, "after").otherwise("before")).when(after < before, "after").otherwise("before")


def restyled(text: Column, styles: dict[str, str]) -> Column:
    """An SVG text with attributes given new values everywhere."""
    for name, value in styles.items():
        text = F.regexp_replace(text, rf'\b{name}="[^"]*"', f'{name}="{value}"')
    return text


def best_gap(trials: DataFrame, by: list[str], gap: str, overlaps: str) -> DataFrame:
    """The trial of each drawing with the fewest overlaps, the one of the least gap among equals."""
    best = F.min(F.struct(F.col(overlaps).alias("o"), F.col(gap).alias("g")))
    return trials.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.g").alias(gap), F.col("_b.o").alias(overlaps))
