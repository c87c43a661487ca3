"""Session helpers: defaults for local runs and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster supplies its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("turnloom")
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, as `--py-files` would.

    The archive is staged on the driver; executors fetch it through Spark.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="turnloom-"), "turnloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local run may fall back to a temporary folder: on a cluster other executors could
    not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="turnloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def tables_folder(spark: SparkSession) -> str:
    """Where `write_table` puts this application's tables."""
    return os.path.join(shared_folder(spark), "turnloom", spark.sparkContext.applicationId)


BROADCAST_ROWS, BROADCAST_BYTES = 1 << 17, 1 << 20
STATIC, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
SHUFFLED, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 2 << 20
INITIAL, SHUFFLE_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 512


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, sides are broadcast by the size their finished shuffles have, not by that of files.

    A few MB of Parquet can be many millions of rows, and building one table of them is the driver's work.
    The table takes some three times its rows, and a plan of many joins builds its tables at once, so
    only sides of up to `BROADCAST_BYTES` are sent.
    """
    limit, adaptive = spark.conf.get(STATIC), spark.conf.get(ADAPTIVE, None)
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit if adaptive is None else adaptive))
    spark.conf.set(ADAPTIVE, str(min(most, BROADCAST_BYTES)))
    spark.conf.set(STATIC, "-1")
    try:
        yield
    finally:
        spark.conf.set(STATIC, limit)
        if adaptive is None:
            spark.conf.unset(ADAPTIVE)
        else:
            spark.conf.set(ADAPTIVE, adaptive)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, a task reads about `TASK_BYTES` of a shuffle, in so far as keys allow it, whatever the size of the input.

    Counts and labels compress to a few bytes a row, so the 64 MB Spark aims at are millions of rows, which
    a sort or an aggregation of the task holds at their full size.
    """
    wanted = max(SHUFFLE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    before = {key: spark.conf.get(key, None) for key in (SHUFFLED, INITIAL)}
    spark.conf.set(SHUFFLED, str(TASK_BYTES))
    spark.conf.set(INITIAL, str(wanted))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_table(spark: SparkSession, name: str, df: DataFrame, small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage that survives
    executor loss, column pruning and filter pushdown for every reader.

    A table of more than `small_rows` rows asks its joins to merge, since its file size would pass for
    one that can be broadcast.
    """
    path = os.path.join(tables_folder(spark), f"{name}-{uuid.uuid4().hex}")
    with measured_joins(spark), small_tasks(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if table.count() > small_rows else table  # the count reads file footers only


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """Bytes, files and time of change of each path, or None where there is nothing."""
    found = []
    for path in paths:
        where, files = _located(spark, path)
        if files.exists(where):
            content = files.getContentSummary(where)
            found.append((path, content.getLength(), content.getFileCount(),
                          files.getFileStatus(where).getModificationTime()))
        else:
            found.append((path, None))
    return tuple(found)


def release(spark: SparkSession) -> None:
    """Delete the tables this application wrote. Results that still read them can't be used after it."""
    where, files = _located(spark, tables_folder(spark))
    files.delete(where, True)
