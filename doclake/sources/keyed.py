"""A stored table with one row per key that can be written to again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, key: list[str], newest: list[str], buckets: int = BUCKETS) -> None:
    """Put ``rows`` into the table at ``path``: per ``key`` the row with the largest ``newest`` columns stays.

    Rows lie in folders by a hash of the key. Only the folders that the new rows fall in are read and replaced, each
    as a whole (dynamic partition overwrite), the files of the others stay. Writing the same rows twice, or older
    ones, changes nothing, so a run that was cut off can be repeated. ``newest`` should tell rows of a key apart;
    of equal ones any may stay. ``buckets`` belongs to the table: always pass the same number. One writer at a time.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", bucket_of(key, buckets))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]      # at most ``buckets`` numbers
    if not touched:
        return
    old = read(spark, path, rows.schema)
    if old is not None:
        rows = rows.unionByName(old.filter(F.col("bucket").isin(touched)))
    fields = [c for c in rows.columns if c not in key]
    latest = (rows.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*newest)).alias("r"))
              .select(*key, "r.*").hint("rebalance", "bucket"))
    (latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table with its column ``bucket``; None where nothing has been written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
