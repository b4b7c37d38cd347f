"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helispan")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where the session names none, one machine takes a temporary folder; a cluster has to name one, as
    its executors would each write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="helispan-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Tables written since each open ``finished`` of this thread began.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the ``finished`` around it ends."""
    path = f"{shared_dir(spark)}/helispan/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    The result has no lineage: losing an executor later costs a read, not a recomputation.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialize what ``build`` returns and delete the tables that were written on the way to it."""
    path = shared_path(spark, name)
    own: list[str] = []
    before = _OPEN.set((*_OPEN.get(), own))
    try:
        df = build()
        df.write.parquet(path)
    finally:
        _OPEN.reset(before)
        for old in own:
            _delete(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete everything that is still below the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/helispan")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as its Python functions import it."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='helispan-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
