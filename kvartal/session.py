"""Session helpers: settings that every plan relies on, and where lineage may be cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kvartal")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KVARTAL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one of spark.checkpoint.dir. Only a session on one machine may do
    without and gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="kvartal-checkpoint-")


_scopes: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that checkpointed writes inside are deleted at the end, for jobs that repeat in one session. Results
    must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target, files = _path(spark, path)
            files.delete(target, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, so without its lineage.

    The table is columnar and compressed, a fraction of what a checkpoint of rows takes, and later steps read
    only the columns they use. It is deleted when the session ends, or at the end of released. The shuffle files of
    writing it go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/kvartal-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores.

    Only an input in fewer pieces is shuffled, by a hash of its key, so that a small file doesn't leave the
    cluster idle; large inputs keep their scan's partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df
