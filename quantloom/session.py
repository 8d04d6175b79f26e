"""Session settings that every plan relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# A group of at most this many rows may be handled by one window task (it can spill);
# above it the distributed rank and aggregate-and-join forms are used.
MAX_WINDOW_GROUP = 10_000_000

HUGE_METHOD, DEFAULT_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535"

# Source rows in a partition of a panel dealt by symbol, on average and at most.
SPREAD_ROWS = 500_000


def window_group_limit(spark: SparkSession) -> int:
    """Largest group one window task may hold; ``quantloom.window.maxGroupRows`` overrides it."""
    return int(spark.conf.get("quantloom.window.maxGroupRows", str(MAX_WINDOW_GROUP)))


def compiled_methods(spark: SparkSession) -> None:
    """Give up whole-stage code where a method is too long for the JVM to compile (8000 bytes), unless the caller has chosen a limit.

    Spark's default runs such methods in the bytecode interpreter; without whole-stage code the same formulas are cut
    into short methods. Rows are the same either way.
    """
    if spark.conf.get(HUGE_METHOD, DEFAULT_LIMIT) == DEFAULT_LIMIT:
        spark.conf.set(HUGE_METHOD, "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def cut(df):
    """Cut the lineage of ``df`` with a reliable checkpoint, so that later branches do not recompute it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df):
    """``df`` written once as Parquet beside the checkpoints of ``cut``, for later branches that read a few of its columns each."""
    own = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    folder = f"{shared_dir(df.sparkSession) if own.isEmpty() else own.get()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def spread(df, key: str, rows: int):
    """Hash ``df`` by ``key`` into a number of partitions that AQE leaves alone.

    Trailing windows cost far more time than bytes, so a coalesced exchange would run them on few cores.
    The number follows the row count, between the cores and ``spark.sql.shuffle.partitions``; it goes beyond the latter
    only where a partition would hold more than ``SPREAD_ROWS`` rows, so that a task's memory does not grow with the table.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(min(most, cores), min(most, rows // 200_000), -(-rows // SPREAD_ROWS)), key)


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller supplies its own, with a shared folder."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quantloom")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
