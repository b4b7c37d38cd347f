"""Left joins to a table with one row for each key, safe with keys that hold a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables up to so many narrow rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than this part of all rows, so that there are fewer hot keys than its inverse.
HOT = 1 / 512
_SPREAD = 1 << 20


def lookup(df: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``df`` with the columns of ``table``, null where it has no row for the keys.

    ``table`` is a written table, unique by ``keys``; its column ``weight`` says how many rows of ``df``
    have the key, of ``total``. A table beyond BROADCAST_ROWS is joined by a shuffle, in which rows of hot
    keys, found by broadcast, are spread over all partitions. Null keys find nothing.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table.drop(weight)), keys, "left")
    hot = table.where(F.col(weight) > HOT * total).select(*keys, F.struct(*values).alias("_hot"))
    found = df.join(F.broadcast(hot), keys, "left")
    alone = reduce(or_, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    spread = found.withColumn("_salt", F.when(alone, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD))).otherwise(0))
    cold = table.select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    both = spread.join(cold, [*keys, "_salt"], "left")
    return both.select(*df.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])
