"""From parsed files to a matrix database: filters, node construction, joined databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.operators import axis

#: Names of amino acid residues.
AMINO_ACIDS = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()


def kept_kinds(segments: DataFrame, with_310: bool = False, with_pi: bool = False) -> DataFrame:
    """Strands and alpha helices, and the other helices if asked for."""
    return segments.where(F.col("kind").isin("strand", "alpha", *(["310"] if with_310 else []), *(["pi"] if with_pi else [])))


def long_enough(segments: DataFrame, least: int) -> DataFrame:
    """Segments of so many residues at least."""
    return segments.where(F.col("hi") - F.col("lo") + 1 >= least)


def chosen(segments: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """The segments, chains or domains of a list (P5); a task holds its part of the list, and segments pass it unsorted."""
    return segments.join(ids.select(*key).distinct().hint("shuffle_hash"), key, "left_semi")


def unknown(segments: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """Listed ids that name nothing, which is an error of the list (P5); ids are held against those found, not against all segments."""
    found = chosen(segments.select(*key), ids, key).distinct()
    return ids.select(*key).distinct().join(found.hint("shuffle_hash"), key, "left_anti")


def useful_chains(segments: DataFrame, by: list[str], with_310: bool = False, with_pi: bool = False) -> DataFrame:
    """Segments of the chains that have a strand, an alpha helix, or another helix that is asked for."""
    return segments.join(kept_kinds(segments, with_310, with_pi).select(*by).distinct(), by, "left_semi")


def amino_acids(residues: DataFrame, strict: bool = False) -> DataFrame:
    """Residues that are amino acids, by name; ``strict`` leaves out those with a ``het`` flag."""
    d = residues.where(F.upper("name").isin(*AMINO_ACIDS))
    return d.where(F.coalesce(F.trim("het"), F.lit("")) == "") if strict else d


def nodes(segments: DataFrame, by: list[str], chain: str, least: int = 1, with_310: bool = False, with_pi: bool = False) -> DataFrame:
    """A structure's segments as numbered nodes: adds ``seg``, from 0 in the order of chains and residues.

    Chains without use go, then helices of kinds not asked for and short segments.
    """
    d = long_enough(kept_kinds(useful_chains(segments, [*by, chain], with_310, with_pi), with_310, with_pi), least)
    return d.withColumn("seg", F.row_number().over(Window.partitionBy(*by).orderBy(chain, "lo", "hi")) - 1)


def database(segments: DataFrame, atoms: DataFrame, by: list[str], chain: str, **kept: object) -> DataFrame:
    """``by, types, codes, omegas, dists``: every structure's packed matrices from its segments and central atoms.

    ``segments`` has by, chain, kind, lo, hi and perhaps sheet; ``atoms`` by, chain, ord, x, y, z.
    Structures without segments are missing.
    """
    n = nodes(segments, by, chain, **kept)  # type: ignore[arg-type]
    sheet = n.select(*by, "seg", (F.col("sheet") if "sheet" in n.columns else F.lit(None)).cast("string").alias("sheet"))
    inside = atoms.join(n.select(*by, chain, "seg", "kind", "lo", "hi"), [*by, chain]).where("ord between lo and hi")
    fitted = axis.axes(inside.select(*by, "seg", "kind", "ord", "x", "y", "z"), by)
    # Segments without atoms have no axis and keep their place.
    all_ = n.select(*by, "seg", "kind").join(fitted.drop("kind"), [*by, "seg"], "left").join(sheet, [*by, "seg"])
    cells = axis.matrices(all_, by)
    row = F.sort_array(F.collect_list(F.struct("j", "i", "code", "omega", "dist")))
    packed = cells.groupBy(*by).agg(row.alias("r")).select(*by, *[F.col("r")[c].alias(f"{c}s") for c in ("code", "omega", "dist")])
    types = n.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", F.when(F.col("kind") == "strand", "E").otherwise("H").alias("t")))), lambda x: x["t"]), "").alias("types"))
    return types.join(packed, by)


def joined(first: DataFrame, second: DataFrame, by: list[str], one: str, two: str) -> DataFrame:
    """Two databases of packed matrices side by side: by, both matrices, ``outcome``.

    ``outcome`` is joined, missing (not in the second database) or order (matrices of different order).
    """
    d = first.select(*by, one).join(second.select(*by, F.col(two).alias("_two")), by, "left")
    outcome = F.when(F.col("_two").isNull(), "missing").when(F.size(one) != F.size("_two"), "order").otherwise("joined")
    return d.select(*by, F.col(one).alias("one"), F.col("_two").alias("two"), outcome.alias("outcome"))


def order_of(packed: Column) -> Column:
    """Rows of a square matrix given as its packed triangle."""
    return F.floor((F.sqrt(8.0 * F.size(packed) + 1) - 1) / 2).cast("int")


def joined_text(both: DataFrame, name: str, form: str = "%6.3f", width: int | None = None) -> DataFrame:
    """``name, n, text``: header, code triangle and number triangle of the matrices that were joined, smaller ones first.

    A longer name than six characters moves what follows it, or is cut to ``width`` columns in the header.
    """
    d = both.where("outcome = 'joined'").withColumn("n", order_of(F.col("one")))

    def triangle(cells: Column, cell) -> Column:  # noqa: ANN001
        return F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.array_join(F.transform(F.slice(cells, (j * (j + 1) / 2).cast("int") + 1, j + 1), cell), " ")), "\n")

    number = lambda x: F.format_string(form, F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    title = F.upper(F.col(name).cast("string"))
    text = F.concat(F.format_string("%-6s %4d\n", F.substring(title, 1, width) if width else title, "n"), triangle(F.col("one"), lambda x: x), F.lit("\n"), triangle(F.col("two"), number))
    return d.select(name, "n", text.alias("text")).orderBy("n", name)


def with_metadata(members: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Members of clusters beside the method and resolution of their structure's file."""
    return members.join(headers.dropDuplicates([key]), key, "left")


def permuted(cells: DataFrame, by: list[str], seed: int) -> DataFrame:
    """A symmetric matrix's cells with rows and columns in an order drawn by a seed, the same for both (F32)."""
    places = cells.select(*by, F.explode(F.array("i", "j")).alias("old")).distinct()
    drawn = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("old").cast("string"))), "old")) - 1
    order = places.withColumn("new", drawn)
    d = cells.join(order.select(*by, F.col("old").alias("i"), F.col("new").alias("_i")), [*by, "i"]).join(order.select(*by, F.col("old").alias("j"), F.col("new").alias("_j")), [*by, "j"])
    rest = [c for c in cells.columns if c not in (*by, "i", "j")]
    return d.select(*by, F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), *rest)


def farthest(rows: DataFrame, by: list[str], key: str, dist: str) -> DataFrame:
    """The farthest row of each group, the one of the least key among equals (T5)."""
    best = F.min(F.struct((-F.col(dist)).alias("d"), F.col(key).alias("k")))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.k").alias(key), (-F.col("_b.d")).alias(dist))


def union_list(gold: list[DataFrame], extra: DataFrame, key: str) -> DataFrame:
    """Gold standards and a fixed list one after the other, repeats kept."""
    out = extra.select(key)
    for g in gold:
        out = out.unionByName(g.select(key))
    return out


def statistics(files: DataFrame, database_: DataFrame, key: str, packed: str) -> DataFrame:
    """One row: files, keys, keys seen more than once, matrices and their cells."""
    keys = files.groupBy(key).agg(F.count("*").alias("n"))
    a = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    b = database_.agg(F.count("*").alias("n_matrices"), F.coalesce(F.sum(F.size(packed)), F.lit(0)).alias("n_cells"))
    return a.join(F.broadcast(b))  # one row each
