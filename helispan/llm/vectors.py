"""Exact metric range join of embeddings.

Unit vectors within the threshold's angle of each other have angles to any third vector that differ
by no more (the triangle inequality), and lie within r = sqrt(2 - 2 t). Pivots divide the vectors into
cells of the nearest pivot. A vector goes to the cells after its own in which it can have a partner:
not to a cell if its angle to some pivot is further than the threshold's from all that the cell's
vectors have to that pivot, and not if the plane between both pivots is further away than r. Then each
cell finds the pairs of its own vectors, and those with vectors of cells before, without the others.
Large cells are compared block by block, so a task holds two blocks whatever the size of a cell.
Equal vectors are one vector with copies. Cosines are told in single precision where they are clear of
the threshold by more than its rounding, and in double precision otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches, bundles, runs
from helispan.llm.links import SCHEMA, Links
from helispan.llm.lookup import lookup
from helispan.operators.graph import connected_components
from helispan.session import finished, materialize

COSINE = 0.95
#: Pivots grow with the square root of the vectors, one for each so many of it, up to the most; they are the vectors of least hash.
ROOT_PER_PIVOT = 20
MAX_PIVOTS = 256
#: Vectors in a block of a cell.
BLOCK = 8192
#: Rows of a block that are compared at once.
STRIP = 512
#: Slack for rounding in angles and distances; it only adds replicas.
SLACK = 1e-6
#: Vectors with links up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def _valid(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: key (their doubles as bytes), width, vec_id (the least), copies."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                if values is None or not len(values) or values.null_count:
                    out.append(None)
                    continue
                a = values.to_numpy() + 0.0
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=schema)

    return d.mapInArrow(keys, "vec_id long, key binary")


def _units(keys: list[bytes]) -> np.ndarray:
    """Unit vectors; components are scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(keys), dtype=np.float64).reshape(len(keys), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pivots(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots by number of dimensions."""
    out = {}
    for width, n in distinct.groupBy("width").count().collect():
        count = min(MAX_PIVOTS, max(1, math.isqrt(n) // ROOT_PER_PIVOT))
        rows = distinct.where(F.col("width") == width).orderBy(F.xxhash64("key"), "key").limit(count).select("key").collect()
        out[width] = _units([bytes(r["key"]) for r in rows])
    return out


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, rows and unit vectors, a thousand rows at once."""
    width = batch.column(column).to_numpy()
    keys = batch.column(0).to_pylist()
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, max(1, len(own) // 1000)):
            yield w, part, _units([keys[i] for i in part])


def _homes(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``home``, the number of the nearest pivot."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int64)
            for w, part, u in _by_width(batch, 3):
                home[part] = _angles(u, shared.value[w]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(home)], names=["key", "vec_id", "copies", "width", "home"])

    return distinct.select("key", "vec_id", "copies", "width").mapInArrow(rows, "key binary, vec_id long, copies long, width int, home long")


def _bounds(homes: DataFrame, pivots: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions, least and largest angle of each cell's vectors to each pivot (none: inf, -inf)."""
    shared = homes.sparkSession.sparkContext.broadcast(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            home = batch.column(2).to_numpy()
            for w, part, u in _by_width(batch, 1):
                angle = _angles(u, shared.value[w])
                for h in np.unique(home[part]).tolist():
                    own = angle[home[part] == h]
                    for k, (low, high) in enumerate(zip(own.min(axis=0).tolist(), own.max(axis=0).tolist(), strict=True)):
                        a, b = found.get((w, h, k), (np.inf, -np.inf))
                        found[w, h, k] = min(a, low), max(b, high)
        cells = [[c[i] for c in found] for i in range(3)]
        ends = [[v[i] for v in found.values()] for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cells[1:]), *(pa.array(e, pa.float64()) for e in ends)], names=["width", "home", "pivot", "low", "high"])

    each = homes.select("key", "width", "home").mapInArrow(rows, "width int, home long, pivot long, low double, high double")
    out = {w: (np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for w, p in pivots.items()}
    # At most MAX_PIVOTS squared rows for each number of dimensions.
    for r in each.groupBy("width", "home", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r["width"]][0][r["home"], r["pivot"]], out[r["width"]][1][r["home"], r["pivot"]] = r["low"], r["high"]
    return out


def _placed(homes: DataFrame, pivots: dict[int, np.ndarray], bounds: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float) -> DataFrame:
    """Every vector in its home cell and in each later cell where it may have partners: width, cell, own, vid, copies, key."""
    shared = homes.sparkSession.sparkContext.broadcast((pivots, bounds))
    theta, r = math.acos(cosine) + SLACK, math.sqrt(2 - 2 * cosine)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, bounds = shared.value
        for batch in batches:
            home = batch.column(4).to_numpy()
            for w, part, u in _by_width(batch, 3):
                p, h, (low, high) = pivots[w], home[part], bounds[w]
                angle = _angles(u, p)
                near = 2 - 2 * np.cos(angle)
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[h]
                inside = (np.arange(len(p))[None, :] > h[:, None]) & (near - near[np.arange(len(part)), h][:, None] <= 2 * r * apart + SLACK)
                for k in range(len(p)):
                    inside &= (angle[:, k, None] >= low[None, :, k] - theta) & (angle[:, k, None] <= high[None, :, k] + theta)
                inside[np.arange(len(part)), h] = True
                i, c = np.nonzero(inside)
                at = pa.array(part[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), w), pa.int32()), pa.array(c, pa.int64()), pa.array(c == h[i]), *(batch.column(k).take(at) for k in (1, 2, 0))],
                    names=["width", "cell", "own", "vid", "copies", "key"],
                )

    return homes.mapInArrow(rows, "width int, cell long, own boolean, vid long, copies long, key binary")


def _exact(a: bytes, b: bytes) -> float:
    """The cosine of two vectors from sums rounded once."""
    x, y = (v / np.abs(v).max() for v in (np.frombuffer(k, np.float64) for k in (a, b)))
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _compared(batch: pa.RecordBatch, cosine: float) -> pa.RecordBatch:
    """Links between two blocks of a cell, or within one block, whose rows are all on the left.

    Vectors are dealt to blocks by hash, so one of two blocks may have none.
    """
    left, keys = batch.column("left").to_numpy(zero_copy_only=False), batch.column("key").to_pylist()
    vid = batch.column("vid").to_numpy()
    u = _units(keys)
    single = u.astype(np.float32)
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    links = Links(batch.column("copies").to_numpy())
    slack = max(1e-5, u.shape[1] * 2e-7)
    within = batch.column("i")[0] == batch.column("j")[0]
    for at in range(0, len(one), STRIP):
        rows = one[at : at + STRIP]
        columns = one[at:] if within else two
        close = single[rows] @ single[columns].T
        found = close >= cosine
        for i, j in np.argwhere(np.abs(close - cosine) <= slack).tolist():
            value = float(u[rows[i]] @ u[columns[j]])
            found[i, j] = (_exact(keys[rows[i]], keys[columns[j]]) if abs(value - cosine) < 1e-12 else value) >= cosine
        if within:
            found &= np.arange(len(columns))[None, :] > np.arange(len(rows))[:, None]
        if found.any():
            some, linked = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
            links.add(rows[some], columns[linked], found[np.ix_(some, linked)])
    return links.rows(vid)


def _links(placed: DataFrame, cosine: float) -> DataFrame:
    """Links found in all pairs of an own block and a block of the same cell: itself, a later own one, or one of vectors from other cells."""
    sizes = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.count_if("own").alias("m"))
    # One row for each cell, and cells are at most MAX_PIVOTS for each number of dimensions.
    dealt = placed.join(F.broadcast(sizes), ["width", "cell"])
    own, other = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int")
    spot = F.xxhash64("vid", F.lit(1))
    block = F.when(F.col("own"), F.pmod(spot, own)).otherwise(own + F.pmod(spot, other)).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("own_blocks", own).withColumn("blocks", own + other)
    firsts = F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    before = F.least(F.col("block"), F.col("own_blocks"))
    seconds = F.when(before > 0, F.transform(F.sequence(F.lit(0), before - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    rows = dealt.select("width", "cell", "vid", "copies", "key", F.explode(F.concat(F.when(F.col("own"), firsts).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")), seconds)).alias("at"))
    rows = rows.select("width", "cell", "at.i", "at.j", "at.left", "vid", "copies", "key")
    keys = ["width", "cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in bundles(runs(batches, 0, 1, 2, 3), 50):
            yield pa.concat_batches([_compared(b, cosine) for b in some])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, SCHEMA)


def _classes(keyed: DataFrame, cosine: float) -> DataFrame:
    """``key, component_id, n`` of the vectors that have copies or links; component_id is the least id in the component, null if it has none.

    Vectors are told apart by numbers of their own, not by ids, which may be null or repeated.
    """
    distinct = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    numbered = distinct.withColumn("width", (F.octet_length("key") / 8).cast("int")).withColumn("vec_id", F.monotonically_increasing_id())
    distinct = materialize(numbered, "distinct")
    pivots = _pivots(distinct)
    homes = materialize(_homes(distinct, pivots), "homes")
    placed = materialize(_placed(homes, pivots, _bounds(homes, pivots), cosine), "placed")
    links = materialize(_links(placed, cosine), "links")
    joined = connected_components(links).select(F.col("node").alias("vec_id"), "component")
    counts = links.groupBy(F.col("src").alias("vec_id")).agg(F.sum("links").alias("links"))
    known = distinct.join(joined, "vec_id", "left").join(counts, "vec_id", "left").where("copies > 1 or component is not null")
    known = materialize(known.select("key", "least", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "known")
    tops = materialize(known.where("component is not null").groupBy("component").agg(F.min("least").alias("top"), F.count("*").alias("rows")), "tops")
    found = lookup(known, tops, ["component"], "rows", known.count())
    return found.select("key", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id"), "n")


def join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors link only with those of as many dimensions. Copies link with each other. Each row is a vector, whatever
    its id: rows without an id link and connect others, but their component is named by the least id in it, null if
    there is none, and they are not kept; rows with one id have links of their own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)

    def build() -> DataFrame:
        keyed = materialize(_valid(vectors), "vectors")
        known = finished(spark, lambda: _classes(keyed, cosine), "known")
        # Copies share a key; beyond the bound, the join is one whose hot partitions Spark splits.
        known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
        out = keyed.join(known, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    return finished(spark, build, "joined")
