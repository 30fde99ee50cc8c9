"""Session settings the jobs rely on."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE may add a shuffle to split a skewed partition; ANSI mode is Spark 4's default.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Merge shuffle partitions up to the advisory size; a full run has many stages side by side.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Shuffled bytes are compressed: 64 MB of parcel numbers, the default, are gigabytes in the hash table of one task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JIT refuses methods above 8000 bytes; past that, let Spark generate split code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# For plans that are executed once, such as a relation that is written: what they shuffle goes when they end.
ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> Iterator[None]:
    """Settings for the jobs of a run, where the caller has set none; they are taken back afterwards."""
    own = [name for name in settings if spark.conf.get(name, None) is None]
    for name in own:
        spark.conf.set(name, settings[name])
    try:
        yield
    finally:
        for name in own:
            spark.conf.unset(name)


def local_session(cores: str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("linderos")
    n = os.cpu_count() if cores == "*" else int(cores)
    settings = SETTINGS | {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        # Sized for sample data; a cluster keeps its own.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
        "spark.ui.showConsoleProgress": "false",
        # A full run generates some 300 classes; the default of 100 would recompile them every run.
        "spark.sql.codegen.cache.maxEntries": "4000",
        # Plans of the whole catalogue are long; call sites in error messages cost more than the plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | extra
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
