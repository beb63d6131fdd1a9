"""A stored index of the queue: positions and waits of a few rows without ordering all active jobs.

Time is cut into ranges. The index holds, per range with active jobs, how many jobs and pages come before it, and
the active jobs themselves by range. A row looks up its own range: what comes before the range is one row of the
first table, what comes before the row within the range are the few jobs of that range in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators.jobs import ACTIVE, list_jobs, with_progress
from doclake.operators.skew import running_totals
from doclake.sources.scratch import passing

RANGE_SEC = 60
SPAN_SEC = 3600         # the active jobs are stored by span, so that a lookup opens few files


def _range(col: str) -> Column:
    return F.floor(F.col(col) / RANGE_SEC).cast("bigint")


def _span(col: str) -> Column:
    return F.floor(F.col(col) / SPAN_SEC).cast("bigint")


def build_queue_index(jobs: DataFrame, path: str) -> None:
    """Store the index of the active jobs of ``jobs`` below ``path``: ``before`` and ``active``."""
    pages = F.coalesce(F.nullif(F.col("page_total"), F.lit(0)), F.lit(1)).cast("bigint")
    # jobs of one instant are one row: ties have one answer, and a hot instant is small
    instants = (jobs.filter(ACTIVE).filter("created_at IS NOT NULL").groupBy("created_at")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(pages).alias("pages")))
    instants = instants.withColumns({"range": _range("created_at"), "span": _span("created_at")})
    (instants.repartition("span", "range").sortWithinPartitions("span", "range")
     .write.mode("overwrite").partitionBy("span").parquet(f"{path}/active"))
    spark = jobs.sparkSession
    with passing(spark):
        ranges = (spark.read.parquet(f"{path}/active").groupBy("range")
                  .agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")))
        running_totals(ranges, [], [F.col("range")], {"n_before": F.col("n"), "pages_before": F.col("pages")}).select(
            "range", "n_before", "pages_before").write.mode("overwrite").parquet(f"{path}/before")


def places(rows: DataFrame, path: str) -> DataFrame:
    """Queued jobs of ``rows`` with ``ahead`` and ``pages_ahead``, the active jobs and their pages created strictly before.

    ``rows`` are jobs that the index has seen. Their ranges are the only ones that are looked up.
    """
    spark = rows.sparkSession
    queued = rows.filter(F.col("status") == "queued").withColumns({"range": _range("created_at"), "span": _span("created_at")})
    asked = queued.select("span", "range", "created_at").distinct()
    inside = (asked.withColumnRenamed("created_at", "_at").join(spark.read.parquet(f"{path}/active"), ["span", "range"])
              .filter(F.col("created_at") < F.col("_at")).groupBy("_at").agg(F.sum("n").alias("_n"), F.sum("pages").alias("_pages")))
    found = (queued.join(spark.read.parquet(f"{path}/before"), "range", "left")
             .join(inside.withColumnRenamed("_at", "created_at"), "created_at", "left"))
    zero = F.lit(0)
    return found.select(*rows.columns, (F.col("n_before") + F.coalesce("_n", zero)).alias("ahead"),
                        (F.col("pages_before") + F.coalesce("_pages", zero)).alias("pages_ahead"))


def indexed_view(jobs: DataFrame, path: str, now: float, session: str | None = None, admin: bool = False,
                 limit: int | None = C.LIST_LIMIT) -> DataFrame:
    """``jobs.session_view`` by the index, with ``wait_sec`` of queued jobs; the flag of running jobs is left out."""
    shown = list_jobs(jobs, session, admin, limit)
    found = places(shown, path)
    rest = shown.filter(~F.coalesce(F.col("status") == "queued", F.lit(False)))
    none = F.lit(None).cast("bigint")
    rows = rest.withColumns({"ahead": none, "pages_ahead": none}).unionByName(found)
    return (with_progress(rows, now).withColumn("wait_sec", F.col("pages_ahead") * F.lit(C.SEC_PER_PAGE))
            .drop("session_id", "result_dir"))


def read_before(spark: SparkSession, path: str) -> DataFrame:
    """``range, n_before, pages_before``."""
    return spark.read.parquet(f"{path}/before")
