"""Mixing sources to target weights by repeating documents.

Sizes are added up by source; a source's target is its share by weight of all sizes, at most three
times its own size, with what exceeds that shared again by weight. Its rate is target over size, and
each document is taken floor(rate) times and once more with the probability of the fraction, decided
by a hash of its id and a seed, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.llm.text import words
from helispan.session import materialize

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
SEED = 20260706
#: A table of sources up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Parts into which each source's rows are dealt for that join.
SALTS = 64


def sizes(text: str = "text") -> Column:
    """The number of words; a null text has none."""
    return F.size(words(text)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by code points of the source with null last, without one task for all.

    Strings compare by their UTF-8 bytes, which is the order of code points.
    """
    part = F.spark_partition_id()
    ordered = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", part), "sources")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("first") + within).drop("part", "first")


def targets(sized: DataFrame) -> DataFrame:
    """Per source: source, source_size, target, from rows of ``source`` and ``size``.

    Only totals reach the driver: each round caps the sources whose share is above their most and
    raises the level of the others, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    by_source = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = materialize(by_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap")), "weights")
    total, weights = table.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (total or 0.0) / weights if weights else 0.0
    while True:
        above = F.col("weight") * level > F.col("cap")
        capped, free = table.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        raised = (total - (capped or 0.0)) / free if free else level
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _taken(docs: DataFrame, id_column: str, text_column: str, by_source: DataFrame) -> DataFrame:
    """Adds source_size, target and ``copies`` to rows with ``source``; the sources are few or the join is salted.

    The draw is by the id, or by the hash of the text where there is none.
    """
    own = F.when(F.col(id_column).isNotNull(), F.xxhash64(F.lit(SEED), F.col(id_column))).otherwise(F.xxhash64(F.lit(SEED), F.lit("text"), F.col(text_column)))
    if by_source.count() <= BROADCAST_ROWS:
        d = docs.join(F.broadcast(by_source), docs["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    else:
        salted = by_source.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        d = docs.withColumn("_salt", F.pmod(own, F.lit(SALTS)).cast("int"))
        d = d.join(salted, d["source"].eqNullSafe(salted["source"]) & (d["_salt"] == salted["_salt"])).drop(salted["source"]).drop("_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.shiftrightunsigned(own, 11) * F.lit(2.0**-53)
    return d.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), copies, taken.

    Rows with the same id share a draw, and rows without an id share one if their texts are equal; null sources are a source; a source without words
    has target 0; other columns are ignored.
    """
    sized = docs.select("doc_id", "source", sizes().alias("size"), F.xxhash64("text").alias("_text"))
    by_source = targets(sized)
    return _taken(sized, "doc_id", "_text", by_source).drop("_text").withColumn("taken", F.col("size") * F.col("copies"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    columns = docs.columns
    by_source = targets(docs.select("source", sizes().alias("size")))
    own = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)], F.col("source").alias("source"))
    own = own.withColumn("_text", F.xxhash64(f"_k{columns.index('text')}"))
    d = _taken(own, f"_k{columns.index('doc_id')}", "_text", by_source)
    d = d.withColumn("_copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))))
    return d.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)])


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
