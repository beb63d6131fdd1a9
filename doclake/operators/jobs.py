"""Operators on the job table and on its change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators.skew import running_total

ACTIVE = "status IN ('queued', 'running')"


def fold_jobs(events: DataFrame, *by: Column) -> DataFrame:
    """Current state of each job (and of each value of ``by``) from its change log.

    Every operation writes its own fields only. ``max_by`` ignores rows whose ordering is null, which is how
    an operation leaves a field alone. All of it combines on the map side.
    """
    op, seq = F.col("op"), F.col("seq")

    def written_by(name: str, *ops: str) -> Column:
        return F.max_by(name, F.when(op.isin(*ops), seq)).alias(name)

    def kept_if_null(name: str) -> Column:
        return F.max_by(name, F.when(op.isin("create", "finish") & F.col(name).isNotNull(), seq)).alias(name)

    return events.groupBy("id", *by).agg(
        *[written_by(c, "create") for c in ("session_id", "filename", "sha256", "opts_hash", "page_total")],
        written_by("status", "create", "claim", "finish", "requeue"),
        written_by("started_at", "claim", "requeue"),
        written_by("finished_at", "finish"),
        written_by("error", "finish"),
        kept_if_null("result_dir"), kept_if_null("n_tables"), kept_if_null("n_images"),
        F.count_if(op == "requeue").cast("int").alias("attempts"),
        written_by("created_at", "create"),
    )


def list_jobs(jobs: DataFrame, session: str | None = None, admin: bool = False,
              limit: int | None = None) -> DataFrame:
    """The newest ``limit`` jobs of a session, or of everyone for an administrator; all of them without a limit."""
    visible = jobs if admin else jobs.filter(F.col("session_id") == session)
    ordered = visible.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def owned(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(request_id, id, session_id, admin)`` that may read a finished job."""
    done = jobs.filter(F.col("status") == "done").select(
        "id", F.col("session_id").alias("owner"), "filename", "result_dir")
    return (requests.join(done, "id", "left")
            .filter(F.col("owner").isNotNull() & ((F.col("owner") == F.col("session_id")) | F.col("admin")))
            .select("request_id", "id", "filename", "result_dir"))


def queued_counts(jobs: DataFrame) -> DataFrame:
    return (jobs.filter(F.col("status") == "queued").groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("n_queued")))


def earlier_active(jobs: DataFrame, value: Column, out: str, rows: DataFrame | None = None) -> DataFrame:
    """Queued jobs of ``rows`` (all) with ``out``: the sum of ``value`` over active jobs created strictly earlier.

    Jobs of one instant are summed first, so that ties share one row and one answer.
    """
    rows = jobs if rows is None else rows
    instants = (jobs.filter(ACTIVE).groupBy("created_at").agg(F.sum(value).alias("_at_instant")))
    totals = running_total(instants, [], [F.col("created_at")], F.col("_at_instant"), out)
    queued = rows.filter(F.col("status") == "queued")
    return queued.join(totals.select("created_at", out), "created_at", "left").select(*rows.columns, out)


def with_ahead(jobs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``jobs`` (all) with ``ahead``, the number of active jobs before a queued one; null for other states."""
    rows = jobs if rows is None else rows
    queued = earlier_active(jobs, F.lit(1), "ahead", rows)
    rest = rows.filter(~F.coalesce(F.col("status") == "queued", F.lit(False)))
    return rest.withColumn("ahead", F.lit(None).cast("bigint")).unionByName(queued)


def is_busy(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("busy"))


def progress(now: float, sec_per_page: float = C.SEC_PER_PAGE) -> Column:
    """Estimated percentage; a running job never shows more than 95."""
    pages = F.coalesce(F.nullif(F.col("page_total"), F.lit(0)), F.lit(1))
    share = (F.lit(now) - F.col("started_at")) / F.greatest(F.lit(1.0), pages * F.lit(sec_per_page)) * 100
    started = F.coalesce(F.col("started_at"), F.lit(0.0)) != 0
    return (F.when(F.col("status") == "done", 100)
            .when((F.col("status") == "running") & started, F.least(F.lit(95.0), share).cast("int"))
            .otherwise(0))


def with_progress(jobs: DataFrame, now: float, sec_per_page: float = C.SEC_PER_PAGE) -> DataFrame:
    return jobs.withColumn("progress", progress(now, sec_per_page))


def serialize(jobs: DataFrame, now: float) -> DataFrame:
    """Rows as a client sees them: progress and position added, owner and paths left out."""
    return with_progress(with_ahead(jobs), now).drop("session_id", "result_dir")


def session_view(jobs: DataFrame, now: float, session: str | None = None, admin: bool = False,
                 limit: int | None = None) -> DataFrame:
    """What a client gets: the visible rows serialized, and on each whether any job runs.

    Only the visible rows are looked up in the queue.
    """
    shown = with_progress(with_ahead(jobs, list_jobs(jobs, session, admin, limit)), now).drop("session_id", "result_dir")
    return jobs.sparkSession.sql("SELECT *, (SELECT busy FROM {busy}) AS busy FROM {shown}", busy=is_busy(jobs), shown=shown)


def next_in_line(jobs: DataFrame, k: int = 1) -> DataFrame:
    return jobs.filter(F.col("status") == "queued").orderBy("created_at", "id").limit(k)


def requeue_running(jobs: DataFrame) -> DataFrame:
    """Jobs left running by a dead worker go back to the queue with one more attempt."""
    orphan = F.col("status") == "running"
    return jobs.withColumns({
        "status": F.when(orphan, "queued").otherwise(F.col("status")),
        "started_at": F.when(~orphan, F.col("started_at")),
        "attempts": (F.col("attempts") + orphan.cast("int")).cast("int"),
    })


def quarantine(jobs: DataFrame, now: float) -> DataFrame:
    """Queued jobs that already cost a worker fail instead of being tried again."""
    poison = (F.col("status") == "queued") & (F.coalesce("attempts", F.lit(0)) >= C.MAX_ATTEMPTS)
    return jobs.withColumns({
        "status": F.when(poison, "failed").otherwise(F.col("status")),
        "error": F.when(poison, C.POISON_MESSAGE).otherwise(F.col("error")),
        "finished_at": F.when(poison, F.lit(now)).otherwise(F.col("finished_at")),
    })


def retain(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.filter(F.col("created_at") >= now - C.RETENTION_SEC)


def expired(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.filter(F.col("created_at") < now - C.RETENTION_SEC)


def orphan_files(files: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """Files ``(kind, name)`` that no retained job refers to.

    Uploads are named by content hash, results by the last part of the result directory.
    """
    kept = retain(jobs, now)
    references = (kept.select(F.lit("upload").alias("kind"), F.col("sha256").alias("name"))
                  .unionByName(kept.filter(F.col("result_dir").isNotNull()).select(
                      F.lit("result").alias("kind"), F.element_at(F.split("result_dir", "/"), -1).alias("name")))
                  .distinct())
    return files.join(references, ["kind", "name"], "left_anti")


def with_label(serialized: DataFrame) -> DataFrame:
    """State text of a serialized job."""
    before, after = C.LABEL_AHEAD
    ahead = F.coalesce("ahead", F.lit(0))
    return serialized.withColumn(
        "label",
        F.when(F.col("status") == "done", C.LABEL_DONE)
        .when(F.col("status") == "running", F.concat(F.col("progress").cast("string"), F.lit("%")))
        .when(F.col("status") == "failed", C.LABEL_FAILED)
        .when(ahead == 0, C.LABEL_STARTING)
        .otherwise(F.concat(F.lit(before), ahead.cast("string"), F.lit(after))))


def session_summary(jobs: DataFrame) -> DataFrame:
    """Per session: running, finished, bulk download offered, and whether others keep the worker busy."""
    return jobs.sparkSession.sql(
        """SELECT session_id, my_running, n_done, n_done >= 2 AS offer_bulk,
                  NOT my_running AND (SELECT coalesce(bool_or(status = 'running'), false) FROM {jobs}) AS show_beat
           FROM (SELECT session_id, bool_or(status = 'running') AS my_running,
                        count_if(status = 'done') AS n_done
                 FROM {jobs} GROUP BY session_id)""", jobs=jobs)
