"""Uploaded files and document text as tables."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import constants as C

LINES_PER_PART = 1024
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_listing = threading.Lock()


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work whose cost is not its bytes: some for each core."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def _folders_share_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists up to 10,000 folders in a task each, which takes far longer to start than to run."""
    with _listing:
        before = spark.conf.get(LISTING_TASKS)
        spark.conf.set(LISTING_TASKS, str(min(int(before), many_tasks(spark))))
        try:
            yield
        finally:
            spark.conf.set(LISTING_TASKS, before)


def scan_uploads(spark: SparkSession, path: str, pattern: str = "*", columns: Sequence[str] = ()) -> DataFrame:
    """Files with length and bytes; the bytes are read only where a query uses them.

    ``columns`` names further columns that folder names like ``table=table-01`` provide.
    """
    with _folders_share_tasks(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "modificationTime", "length", "content", *columns)


def flag_oversize(uploads: DataFrame, max_bytes: int = C.MAX_BYTES) -> DataFrame:
    """Add ``too_big``; the body of such a file is null and is never read, its row stays."""
    fits = uploads.filter(F.col("length") <= max_bytes).withColumn("too_big", F.lit(False))
    big = uploads.filter(F.col("length") > max_bytes).withColumns(
        {"content": F.lit(None).cast("binary"), "too_big": F.lit(True)})
    return fits.unionByName(big)


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8"), F.lit(False))


def with_magic(df: DataFrame, col: str = "content") -> DataFrame:
    return df.withColumn("is_pdf", is_pdf(F.col(col)))


def with_content_hash(df: DataFrame, col: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(col), 256))


def unique_blobs(df: DataFrame) -> DataFrame:
    """One hash per stored blob with its size; copies combine on the map side and no bytes are shuffled."""
    return df.groupBy("sha256").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n_copies"))


def to_lines(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """One row per line, numbered from 0; empty lines stay."""
    return docs.select(key, F.posexplode(F.split(F.col(col), "\n", -1)).alias("n", "x"))


def to_docs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines back into one text per document.

    The lines of a document are first joined in parts of bounded size, so that only the parts of a long
    document, not its lines, come together in one task.
    """
    def joined(order: str, value: str) -> Column:
        rows = F.sort_array(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(rows, lambda r: r[value]), "\n")

    return (lines.groupBy(key, F.floor(F.col("n") / LINES_PER_PART).alias("part")).agg(joined("n", "x").alias("x"))
            .groupBy(key).agg(joined("part", "x").alias("text")))
