"""Reuse of finished work by content hash and option hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import constants as C

KEY = ["sha256", "opts_hash"]


def opts_hash(include_images: Column, include_csv: Column, rev: int = C.CONVERTER_REV) -> Column:
    """First 16 hex digits of the SHA-256 over revision and options."""
    revision, images, csv = C.OPTIONS_FORMAT
    text = F.concat(F.lit(f"{revision}{rev}{images}"), include_images.cast("int"), F.lit(csv), include_csv.cast("int"))
    return F.substring(F.sha2(text, 256), 1, 16)


def with_opts_hash(df: DataFrame, rev: int = C.CONVERTER_REV) -> DataFrame:
    """Add ``opts_hash`` from the boolean columns ``include_images`` and ``include_csv``."""
    return df.withColumn("opts_hash", opts_hash(F.col("include_images"), F.col("include_csv"), rev))


def options(spark: SparkSession, rev: int = C.CONVERTER_REV) -> DataFrame:
    """The four option combinations with their hash at revision ``rev``."""
    rows = [(i, c) for i in (True, False) for c in (True, False)]
    return with_opts_hash(spark.createDataFrame(rows, "include_images boolean, include_csv boolean"), rev)


def decode_opts(jobs: DataFrame, rev: int = C.CONVERTER_REV) -> DataFrame:
    """Recover the options of each job; ``stale`` marks hashes that no combination gives."""
    return (jobs.join(F.broadcast(options(jobs.sparkSession, rev)), "opts_hash", "left")
            .withColumn("stale", F.col("include_images").isNull()))


def fail_stale(jobs: DataFrame, now: float, rev: int = C.CONVERTER_REV) -> DataFrame:
    """Queued jobs whose options cannot be recovered end as failed."""
    decoded = decode_opts(jobs, rev)
    failed = F.col("stale") & (F.col("status") == "queued")
    return decoded.withColumns({
        "status": F.when(failed, "failed").otherwise(F.col("status")),
        "error": F.when(failed, C.STALE_OPTIONS_MESSAGE).otherwise(F.col("error")),
        "finished_at": F.when(failed, F.lit(now)).otherwise(F.col("finished_at")),
    }).select(*jobs.columns)


def cached_results(jobs: DataFrame) -> DataFrame:
    """Newest finished job per content and option hash; equal times are decided by the larger id.

    The aggregate combines on the map side, so many copies of one document shrink before the shuffle.
    """
    newest = F.max(F.struct("created_at", "id", "result_dir", "n_tables", "n_images")).alias("r")
    return (jobs.filter(F.col("status") == "done").groupBy(*KEY).agg(newest)
            .select(*KEY, F.col("r.id").alias("cached_id"), "r.result_dir", "r.n_tables", "r.n_images"))


def apply_cache(uploads: DataFrame, cached: DataFrame) -> DataFrame:
    """A hit becomes a finished row with the earlier result, a miss is queued."""
    hit = F.col("cached_id").isNotNull()
    return uploads.join(cached, KEY, "left").withColumn("status", F.when(hit, "done").otherwise("queued"))


def invalidated(jobs: DataFrame, rev: int) -> DataFrame:
    """Finished jobs that no lookup at revision ``rev`` can find any more."""
    current = options(jobs.sparkSession, rev).select("opts_hash")
    return jobs.filter(F.col("status") == "done").join(F.broadcast(current), "opts_hash", "left_anti")
