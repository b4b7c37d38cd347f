"""Incremental processing of a growing folder (O1-O3): new files only, results replaced by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(inputs: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs without an output (O1); all of them if outputs are to be overwritten."""
    return inputs if overwrite else inputs.join(outputs.select(key), key, "left_anti")


def failed(outputs: DataFrame, bad: str, inputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose output is bad, to be processed again (O3)."""
    return inputs.join(outputs.where(bad).select(key), key, "left_semi")


def update(spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, form: str = "parquet") -> None:
    """Process files that came since the last call and append the results, each batch in a folder of its own.

    Progress is kept in ``checkpoint``; a batch that is run again after a failure replaces its own
    folder, so results are written once. ``latest`` reads them.
    """
    new = spark.readStream.schema(schema).format(form).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).withColumn("written", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest result of each key."""
    d = spark.read.parquet(target).drop("batch")
    return d.groupBy(key).agg(F.max_by(F.struct(*d.columns), "written").alias("_r")).select("_r.*").drop("written")
