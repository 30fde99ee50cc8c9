"""Helpers shared by the operators: shared storage, spare column names, row fingerprints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole documents in an Arrow batch.  Spark's 10,000 rows are meant for numbers; workers hold a few copies of a batch.
BATCH_ROWS = 1_000
#: Largest list of documents (about 100 MB in memory) that is broadcast to pick rows; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application; Spark's file server carries it.

    Also sets the rows of an Arrow batch to BATCH_ROWS where the session has not set it, to bound the workers' memory.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-"), "package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (local tests)."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().conf().get(CHECKPOINT_SETTING, "")
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: cuts the lineage, survives lost executors, computes it once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame | Iterable[str], stem: str) -> str:
    """A column name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def id_type(df: DataFrame, name: str) -> str:
    """The type an id column is given back in: text stays text, everything else is a long."""
    return "string" if df.schema[name].dataType == StringType() else "long"


def with_id(df: DataFrame, kind: str, name: str = "doc_id") -> DataFrame:
    """Ids that went through Python as text, in their own type again.

    pandas holds a long column with a null as floats, which rounds ids above 2^53; text is left alone.
    """
    return df if kind == "string" else df.withColumn(name, F.col(name).cast(kind))


def smallest_keys(keyed: DataFrame, count: int, key: str = "key") -> DataFrame:
    """The rows with the `count` smallest distinct keys, one row a key.

    The keys alone are ordered; rows are then picked by the largest of them, so no task gets other rows' texts.
    """
    return keyed.where(F.col(key) <= F.lit(largest_of_smallest(keyed, count, key)).cast("long")).dropDuplicates([key])


def largest_of_smallest(keyed: DataFrame, count: int, key: str = "key") -> int | None:
    """The largest of the `count` smallest distinct keys; only the keys are read."""
    found = keyed.select(key).distinct().orderBy(key).limit(count).collect()
    return found[-1][0] if found else None


def fingerprint(text: Column) -> Column:
    """128 bits of a text, as two longs; tells rows of one id apart without carrying the text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(17), text, F.length(text)).alias("b"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def picked(small: DataFrame) -> DataFrame:
    """A written table that picks rows of a large one; broadcast if its counted rows allow it."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def single(df: DataFrame) -> Any:
    """The one row of an ungrouped aggregate."""
    return df.collect()[0]
