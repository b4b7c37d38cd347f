"""Strands of a sheet: barrels, sides of neighbours, horizontal order and vertical offsets.

A sheet is a few dozen strands at most, so one group holds it. Bridges are rows for each direction:
``node, other, side`` (+, - or . for none), ``parallel``, and the least and greatest bonded residues
``low_own, low_other, high_own, high_other`` (null without bonds).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opposite(overlap: Column, angle: Column) -> Column:
    """Whether two neighbours of a strand are on opposite sides of it.

    They are if they bond to the same residues; otherwise if the dihedral angle is beyond a right
    angle. No angle means the same side.
    """
    return overlap | F.coalesce(F.abs(angle) > F.lit(3.141592653589793 / 2), F.lit(False))


def side_labels(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by, other, side`` for each strand ``by`` from rows of two of its neighbours, ``first, second, opposite``.

    The neighbour of least name is on the side +, and the others are where they lie towards it; a
    strand's only neighbour has no row and is on +.
    """
    least = pairs.groupBy(*by).agg(F.min(F.least("first", "second")).alias("_least"))
    towards = pairs.join(least, by).where((F.col("first") == F.col("_least")) | (F.col("second") == F.col("_least")))
    other = F.when(F.col("first") == F.col("_least"), F.col("second")).otherwise(F.col("first"))
    rest = towards.select(*by, other.alias("other"), F.when(F.col("opposite"), "-").otherwise("+").alias("side"))
    return least.select(*by, F.col("_least").alias("other"), F.lit("+").alias("side")).unionByName(rest)


def _tree(links: dict[int, list[int]], start: int) -> Iterator[tuple[int, int | None]]:
    """Nodes of a depth-first walk in ascending order of neighbours, each with the one it was reached from."""
    seen, stack = set(), [(start, None)]
    while stack:
        node, origin = stack.pop()
        if node not in seen:
            seen.add(node)
            yield node, origin
            stack += [(n, node) for n in sorted(links[node], reverse=True) if n not in seen]


def _closing(links: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Edges that close cycles: those not walked along from the least node on, each as (lower, higher)."""
    walked, seen, out = set(), set(), []
    for root in sorted(links):
        if root not in seen:
            for node, origin in _tree(links, root):
                seen.add(node)
                walked.add((min(node, origin), max(node, origin)) if origin is not None else None)
    for a in sorted(links):
        out += [(a, b) for b in sorted(links[a]) if a < b and (a, b) not in walked]
    return out


def _links(bridges: list[dict]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for r in bridges:
        found.setdefault(r["node"], []).append(r["other"])
        found.setdefault(r["other"], [])
    return found


def _by_sheet(rows: DataFrame, by: list[str], compute: Callable[[dict], list[dict]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``by`` and the fields that ``compute`` finds for each sheet, from rows of ``by`` and the lists that hold a sheet.

    Tasks go through batches of sheets, as a frame for each of many small groups costs more than the work in it.
    """
    kind = pa.list_(pa.struct([(name, t) for name, _, t in fields]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names) if c not in by}
            out = [compute(dict(zip(lists, own, strict=True))) for own in zip(*lists.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, kind)], names=[*by, "found"])

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema]
    listed = ",".join(f"{name}:{t}" for name, t, _ in fields)
    return rows.mapInArrow(found, ", ".join([*keys, f"found array<struct<{listed}>>"])).select(*by, F.inline("found"))


def closing_edges(bridges: DataFrame, by: list[str]) -> DataFrame:
    """``by, src, dst`` of the bridges that are taken out to open barrels, one for each cycle."""

    def close(sheet: dict) -> list[dict]:
        return [{"src": a, "dst": b} for a, b in _closing(_links(sheet["links"]))]

    rows = bridges.groupBy(*by).agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("other").cast("long").alias("other"))).alias("links"))
    return _by_sheet(rows, by, close, [("src", "bigint", pa.int64()), ("dst", "bigint", pa.int64())])


def opened(bridges: DataFrame, closing: DataFrame, by: list[str]) -> DataFrame:
    """The bridges, in both directions, without those that close barrels."""
    both = closing.select(*by, F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(closing.select(*by, F.col("dst").alias("node"), F.col("src").alias("other")))
    return bridges.join(both, [*by, "node", "other"], "left_anti")


def _column(node: int, origin: int, index: dict[int, int], sides: dict[tuple[int, int], str], links: dict[int, list[int]]) -> int:
    """Place of a strand beside the one it was reached from, by the sides of that one's placed neighbours."""
    own = sides[origin, node]
    placed = [n for n in links[origin] if n != node and n in index and sides[origin, n] != "."]
    if own == "." or not placed:
        return index[origin] + 1
    other = placed[0]
    if sides[origin, other] == own:
        return index[other]
    return index[origin] + (1 if index[other] < index[origin] else -1)


def order_strands(strands: DataFrame, bridges: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, place, reversed, offset, barrel``: each strand's column, direction and height in its sheet.

    ``strands`` has node, lo, hi. Barrels are opened first. The walk starts at an end of the last bridge
    taken out, or at the first strand with one neighbour. A strand is put beside the one it is reached
    from, on the side that its neighbours' sides leave; it points the same way if they are parallel, and
    its height follows from the bonded residues next to the strands' upper ends. Places count from 0.
    """
    names = ["node", "other", "side", "parallel", "low_own", "low_other", "high_own", "high_other"]

    def order(sheet: dict) -> list[dict]:
        span = {r["node"]: (r["lo"], r["hi"]) for r in sheet["strands"]}
        facts = {(r["node"], r["other"]): r for r in sheet["links"]}
        near: dict[int, list[int]] = {n: [] for n in sorted(span)}
        for a, b in sorted(facts):
            near[a].append(b)
        cut = _closing(near)
        for a, b in cut:
            near[a].remove(b)
            near[b].remove(a)
        ends = [n for e in reversed(cut) for n in e if len(near[n]) == 1] + [n for n in near if len(near[n]) == 1] + list(near)[:1]
        sides = {k: f["side"] for k, f in facts.items()}
        barrel = {n for e in cut for n in e}
        place, turned, height = {}, {}, {}
        for node, origin in _tree(near, ends[0]) if ends else ():
            if origin is None:
                place[node], turned[node], height[node] = 0, False, 0
                continue
            fact = facts[node, origin]
            place[node] = _column(node, origin, place, sides, near)
            turned[node] = turned[origin] == bool(fact["parallel"])
            low, high = span[node]
            own_at, other_at = (fact["low_own"], fact["low_other"]) if turned[node] else (fact["high_own"], fact["high_other"])
            if own_at is None:
                own_at = low if turned[node] else high
                other_at = span[origin][0 if turned[node] == bool(fact["parallel"]) else 1]
            mine = own_at - low if turned[node] else high - own_at
            theirs = other_at - span[origin][0] if turned[origin] else span[origin][1] - other_at
            height[node] = height[origin] + theirs - mine
        least = min(place.values(), default=0)
        return [{"node": n, "place": place[n] - least, "reversed": turned[n], "offset": height[n], "barrel": n in barrel} for n in place]

    strand, link = (F.struct(*[F.col(c) if c in ("side", "parallel") else F.col(c).cast("long").alias(c) for c in cs]) for cs in (["node", "lo", "hi"], names))
    own = strands.select(*by, strand.alias("strand"))
    both = own.unionByName(bridges.select(*by, link.alias("link")), allowMissingColumns=True)
    rows = both.groupBy(*by).agg(F.collect_list("strand").alias("strands"), F.collect_list("link").alias("links"))
    fields = [("node", "bigint", pa.int64()), ("place", "bigint", pa.int64()), ("reversed", "boolean", pa.bool_()), ("offset", "bigint", pa.int64()), ("barrel", "boolean", pa.bool_())]
    return _by_sheet(rows, by, order, fields)
