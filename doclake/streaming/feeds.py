"""Structured Streaming forms of admission, de-duplication, job state, change feed and retention.

Each batch writes its output under its own number and overwrites it when the batch is repeated after a
failure, so every output is exact once the batch is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.operators.admission import admit, admit_probed, from_files
from doclake.operators.cache import options
from doclake.operators.jobs import expired, fold_jobs, retain
from doclake.sources.scratch import passing
from doclake.streaming.change_feed import stream_feed  # noqa: F401
from doclake.streaming.run import start

RETENTION = "24 hours"


def stream_to_batches(df: DataFrame, out: str, checkpoint: str, mode: str = "append",
                      every: str | None = None) -> StreamingQuery:
    """Store the rows of each batch under ``out/batch=<n>``."""
    def handle(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    return start(df, checkpoint, mode, handle, every)


def latest(batches: DataFrame, key: list[str]) -> DataFrame:
    """Newest row per key of the stored batches of an update-mode stream."""
    fields = [c for c in batches.columns if c not in (*key, "batch")]
    return (batches.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
            .select(*key, "r.*"))


Jobs = DataFrame | Callable[[], DataFrame]


def _admitting(df: DataFrame, out: str, checkpoint: str, jobs: Jobs, judge: Callable[[DataFrame, DataFrame], DataFrame],
               every: str | None) -> StreamingQuery:
    """Store what ``judge`` makes of each batch and the jobs that are known then."""
    spark = df.sparkSession

    def handle(batch: DataFrame, n: int) -> None:
        known = jobs() if callable(jobs) else jobs
        if n > 0:
            earlier = spark.read.option("basePath", out).parquet(out).filter(F.col("batch") < n).select(*known.columns)
            # the job table tells better than the admission what has become of a job
            known = known.unionByName(earlier.join(known.select("id"), "id", "left_anti"))
        with passing(spark):
            judge(batch, known).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return start(df, checkpoint, "append", handle, every)


def stream_admit(uploads: DataFrame, pages: DataFrame, jobs: Jobs, out: str, checkpoint: str, now: float,
                 every: str | None = None) -> StreamingQuery:
    """Admit uploads as they arrive; each batch sees the job rows of all batches before it.

    ``jobs`` may be a function that reads the job table as it is now: a job that has ended in the meantime no longer
    counts against the quota of its session, and its result is found.
    """
    return _admitting(uploads, out, checkpoint, jobs, lambda batch, known: admit(batch, pages, known, now), every)


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Files below ``folder`` as they arrive, with length and bytes."""
    reader = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)


def stream_admit_files(files: DataFrame, pages: Callable[[], DataFrame], jobs: Jobs, out: str, checkpoint: str,
                       clock: Callable[[], float] = time.time, broken: Callable[[], DataFrame] | None = None,
                       every: str | None = None) -> StreamingQuery:
    """From files to job rows: size, magic bytes, hash, quota, probe and cache for each batch of ``stream_files``.

    ``pages`` and ``broken`` are read anew for each batch (see ``admission.from_files``).
    """
    def judge(batch: DataFrame, known: DataFrame) -> DataFrame:
        rows = from_files(batch, options(batch.sparkSession), pages(), broken() if broken else None)
        return admit_probed(rows, known, clock())
    return _admitting(files, out, checkpoint, jobs, judge, every)


def stream_dedup(jobs: DataFrame) -> DataFrame:
    """First row per content and option hash within the retention time (event time column ``created``).

    Unlike the batch cache, a repeat does not renew the entry, and repeats of unfinished work are dropped too.
    """
    return jobs.withWatermark("created", RETENTION).dropDuplicatesWithinWatermark(["sha256", "opts_hash"])


def stream_entries(uses: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Cache entries ``sha256, opts_hash, first_id, n_uses, started, expires`` from uses (``id, created`` and the key).

    An entry lives for the retention time from its last use: every use within that time renews it, the first one
    after it starts a new entry. Works on a stream (append mode: an entry comes out when the watermark, ``lateness``
    behind the newest use, passes its end; later uses of that time are dropped) and on a table. With
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` the uses of a hot key are merged before
    they are shuffled.
    """
    alive = F.session_window("created", RETENTION)
    return (uses.withWatermark("created", lateness).groupBy("sha256", "opts_hash", alive)
            .agg(F.min_by("id", F.struct("created", "id")).alias("first_id"), F.count(F.lit(1)).alias("n_uses"))
            .select("sha256", "opts_hash", "first_id", "n_uses", F.col("session_window.start").alias("started"),
                    F.col("session_window.end").alias("expires")))


def stream_fold(events: DataFrame) -> DataFrame:
    """Job state from the change log; run it in update mode."""
    return fold_jobs(events)


def stream_expired(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Job rows that end, with ``expires``, from the change log with an event time ``at``.

    A job's state lives for the retention time after its last event; once the watermark, ``lateness`` behind the
    newest event, has passed that time, its final row comes out (append mode) and its state is dropped. Events that
    come later than that are dropped too. So the state holds the jobs of one retention time, whatever the stream's age.
    """
    alive = F.session_window("at", RETENTION).alias("_alive")
    folded = fold_jobs(events.withWatermark("at", lateness), alive)
    return folded.withColumn("expires", F.col("_alive.end")).drop("_alive")


def stream_retain(jobs: DataFrame) -> DataFrame:
    """Job rows once each; rows that are older than the retention time when they arrive are dropped.

    The watermark also bounds the state. Needs the event time column ``created``.
    """
    return jobs.withWatermark("created", RETENTION).dropDuplicates(["id", "created"])


def sweep(jobs: DataFrame, now: float, kept: str, dropped: str) -> None:
    """The scheduled part of retention: store retained and expired rows."""
    retain(jobs, now).write.mode("overwrite").parquet(kept)
    expired(jobs, now).write.mode("overwrite").parquet(dropped)
