"""Shared scratch folder for cutting lineage and for query outputs that are written and read back."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()      # the open blocks of this thread, the innermost last


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, else below the session's warehouse folder.

    Both are folders that the driver and all executors share.
    """
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the stored table, which survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if getattr(_here, "blocks", None):
        _here.blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, where it is there, on whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``freeze`` stores in this block are removed at its end.

    What the block leaves behind must have been stored or collected by then; a DataFrame that still reads one of
    the tables fails.
    """
    if not hasattr(_here, "blocks"):
        _here.blocks = []
    _here.blocks.append([])
    try:
        yield
    finally:
        for path in _here.blocks.pop():
            remove(spark, path)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a stored table, without the tables that ``freeze`` stores on the way to it."""
    path = scratch_path(spark, name)
    with passing(spark):
        df = make()
        df.write.parquet(path)
    if getattr(_here, "blocks", None):
        _here.blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
