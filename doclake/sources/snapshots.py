"""Job tables stored so that folding, comparing and merging them needs little reading and no shuffle.

*Bucketed tables* lie in a fixed number of sorted buckets of the id: what groups or joins them by id runs bucket by
bucket. *Digested snapshots* lie in folders by a hash of the id and carry a tree of digests of these folders: two of
them are compared from the root down, and only folders that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.sources.keyed import bucket_of

BUCKETS = 64
FAN = 16          # nodes below a node of the tree


def write_bucketed(rows: DataFrame, table: str, buckets: int = BUCKETS, key: str = "id") -> DataFrame:
    """Store ``rows`` as a table of the catalog in ``buckets`` buckets, sorted by ``key``, and return it.

    Tables with the same number of buckets join and group by the key without an exchange.
    """
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def _digest(columns: list[str]) -> Column:
    """Of a set of rows, whatever their order: sums of two hashes of each, and their number."""
    row = F.struct(*columns)
    add = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) % F.lit(1 << 62)
    return F.concat_ws(":", F.count(F.lit(1)), add(1).cast("bigint"), add(2).cast("bigint"))


def write_snapshot(rows: DataFrame, path: str, folders: int = 4096, key: str = "id") -> None:
    """Store ``rows`` in folders ``path/rows/folder=<n>`` with ``path/digests`` (``level, node, digest``).

    Level 0 has a node per folder, every node above covers ``FAN`` below; the root is alone on its level.
    """
    spark = rows.sparkSession
    columns = sorted(rows.columns)
    placed = rows.withColumn("folder", bucket_of([key], folders))
    placed.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    level = placed.groupBy(F.col("folder").cast("bigint").alias("node")).agg(_digest(columns).alias("digest"))
    n, nodes = 0, folders
    level.withColumn("level", F.lit(n)).write.mode("overwrite").partitionBy("level").parquet(f"{path}/digests")
    while nodes > 1:
        below = spark.read.parquet(f"{path}/digests").filter(F.col("level") == n)
        up = (below.groupBy(F.floor(F.col("node") / FAN).alias("node"))
              .agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "node", "digest")))), 256).alias("digest")))
        n, nodes = n + 1, -(-nodes // FAN)
        up.withColumn("level", F.lit(n)).write.mode("append").partitionBy("level").parquet(f"{path}/digests")


def changed_folders(spark: SparkSession, old: str, new: str) -> list[int]:
    """Folders whose rows differ: from the root down, only below nodes that differ. At most one number per folder."""
    a, b = spark.read.parquet(f"{old}/digests"), spark.read.parquet(f"{new}/digests")
    level = b.agg(F.max("level")).first()[0]
    wanted = None
    while level is not None and level >= 0:
        left, right = (d.filter(F.col("level") == level).select("node", F.col("digest").alias(name)) for d, name in ((a, "x"), (b, "y")))
        both = left.join(right, "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
        if wanted is not None:
            both = both.filter(F.floor(F.col("node") / FAN).isin(wanted))
        wanted = [r[0] for r in both.select("node").collect()]
        if not wanted:
            return []
        level -= 1
    return sorted(wanted or [])


def read_changed(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in the folders that differ; folders that are equal are not read.

    Written with the same number of folders, a row that changed, came or went lies in one of them on either side, so
    ``operators.feed.apply_full``, ``diff_snapshots`` and ``changed_fields`` give the same changes as on the whole.
    """
    folders = changed_folders(spark, old, new)
    return tuple(spark.read.parquet(f"{path}/rows").filter(F.col("folder").isin(folders)).drop("folder") for path in (old, new))
