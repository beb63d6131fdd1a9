"""The change feed of a job table as a stream: per tick, the rows that clients have to learn.

A row is sent when it is new or running, or when its status, end time or queue position changed. Positions are
kept up incrementally:

* The state is a log: a tick stores the jobs that changed in it (``rows``) and, per range of time, by how much the
  number of active jobs changed (``counts``). Every few ticks the log is folded into a base, so that reading it
  stays cheap; what the base replaces is dropped.
* A tick asks for the earliest job that changed. Jobs created before the span of time it falls in keep their
  positions and are not read: the log is partitioned by span, and their number comes from the counts. From there on
  one running total gives the positions, another one by how much they moved in this tick.

So a tick writes in proportion to what changed and to what it sends. Everything is stored under the number of the
tick and made from earlier ticks only: a tick that is repeated after a failure gives the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.operators.jobs import fold_jobs, progress
from doclake.operators.skew import running_totals
from doclake.sources.scratch import freeze, passing, remove
from doclake.streaming.run import start

RANGE_SEC = 60
SPAN_SEC = 86400          # a whole number of ranges; the log is partitioned by it
FOLD_EVERY = 16           # ticks after which the log is folded
NO_SPAN = -1              # jobs whose creation has not been seen yet


@dataclass
class State:
    """The stored state of a feed. ``rows``, ``counts``, ``running`` and ``ticks`` are folders below ``path``."""
    spark: SparkSession
    path: str

    def place(self, part: str, tick: int) -> str:
        return f"{self.path}/{part}/tick={tick}"

    def store(self, df: DataFrame, part: str, tick: int, by: tuple[str, ...] = ()) -> None:
        # ranges along the folders: else each task would write a file into each folder. Stored before, as ranges are sampled
        rows = freeze(df, part).repartitionByRange(*by, "id") if by else df
        rows.write.mode("overwrite").partitionBy(*by).parquet(self.place(part, tick))

    def _log(self, part: str, tick: int, schema: str) -> DataFrame:
        """The base before ``tick`` and the ticks since, up to ``tick``, with the column ``tick``."""
        base = tick // FOLD_EVERY * FOLD_EVERY - 1
        paths = [self.place(part, t) for t in range(base + 1, tick + 1)]
        if base >= 0:
            paths.insert(0, self.place(f"{part}_base", base))
        out = None
        for path in paths:
            one = self.spark.read.schema(schema).parquet(path).withColumn("tick", F.lit(int(path.rpartition("=")[2])))
            out = one if out is None else out.unionByName(one)
        return out

    def jobs(self, tick: int, schema: str, wanted: Column | None = None) -> DataFrame:
        """The newest row of each job as of ``tick``; ``wanted`` chooses spans, the others are not read."""
        log = self._log("rows", tick, schema)
        log = log if wanted is None else log.filter(wanted)
        fields = [c for c in log.columns if c not in ("id", "tick")]
        return log.groupBy("id").agg(F.max_by(F.struct(*fields), "tick").alias("r")).select("id", "r.*")

    def counts(self, tick: int) -> DataFrame:
        return self._log("counts", tick, "range bigint, change bigint").groupBy("range").agg(F.sum("change").alias("change"))

    def fold(self, tick: int, schema: str) -> None:
        """After the last tick of a round, store the state as the next base and drop the round before.

        The base that this round started from stays: should the tick be repeated, it is read again.
        """
        if (tick + 1) % FOLD_EVERY:
            return
        self.store(self.jobs(tick, schema), "rows_base", tick, ("span",))
        self.store(self.counts(tick).filter("change <> 0"), "counts_base", tick)
        for old in range(tick - 2 * FOLD_EVERY + 1, tick - FOLD_EVERY + 1):
            for part in ("rows", "counts", "running"):
                remove(self.spark, self.place(part, old))
        for part in ("rows_base", "counts_base"):
            remove(self.spark, self.place(part, tick - 2 * FOLD_EVERY))


def _span(created_at: str) -> Column:
    return F.coalesce(F.floor(F.col(created_at) / SPAN_SEC), F.lit(NO_SPAN)).cast("bigint")


def _active(prefix: str = "") -> Column:
    """1 for an active job with a place in the queue."""
    status, created = F.col(f"{prefix}status"), F.col(f"{prefix}created_at")
    return F.coalesce(status.isin("queued", "running") & created.isNotNull(), F.lit(False)).cast("int")


def _changes(delta: DataFrame, before: DataFrame | None) -> DataFrame:
    """The changed jobs with what was known before, and ``was``, ``now``: whether they counted as active."""
    known = ["status", "finished_at", "created_at"]
    old = (delta.limit(0) if before is None else before).select("id", *[F.col(c).alias(f"_{c}") for c in known],
                                                               F.lit(True).alias("_known"))
    both = delta.join(old, "id", "left")
    return both.withColumns({"was": _active("_"), "now": _active(), "changed": (
        F.col("_known").isNull() | ~F.col("status").eqNullSafe(F.col("_status"))
        | ~F.col("finished_at").eqNullSafe(F.col("_finished_at")) | ~F.col("created_at").eqNullSafe(F.col("_created_at")))})


def _earliest(changes: DataFrame) -> float | None:
    """Creation time of the earliest job that changed, before or after the change."""
    return changes.filter("changed").agg(F.min(F.least("created_at", "_created_at"))).first()[0]


def _count_changes(changes: DataFrame) -> DataFrame:
    """By how much each range of time gained or lost active jobs."""
    sides = F.array(F.struct(F.col("_created_at").alias("at"), (-F.col("was")).alias("n")),
                    F.struct(F.col("created_at").alias("at"), F.col("now").alias("n")))
    parts = changes.select(F.explode(sides).alias("s")).select("s.*").filter("n <> 0")
    return (parts.groupBy(F.floor(F.col("at") / RANGE_SEC).cast("bigint").alias("range"))
            .agg(F.sum("n").cast("bigint").alias("change")).filter("change <> 0"))


def _positions(rows: DataFrame, earlier: int) -> DataFrame:
    """``rows`` with ``ahead``, the active jobs created before, and ``moved``, by how much that changed in this tick.

    Jobs of one instant are summed first. Every queued job has its instant among those that are ordered.
    """
    sides = F.array(F.struct(F.col("created_at").alias("at"), F.col("now").alias("n"), F.col("now").alias("change")),
                    F.struct(F.col("_created_at").alias("at"), F.lit(0).alias("n"), (-F.col("was")).alias("change")))
    instants = (rows.select(F.explode(sides).alias("s")).select("s.*").filter("at IS NOT NULL AND (n <> 0 OR change <> 0)")
                .groupBy("at").agg(F.sum("n").alias("n"), F.sum("change").alias("change")))
    totals = running_totals(instants, [], [F.col("at")], {"ahead": F.col("n"), "moved": F.col("change")})
    places = totals.select(F.col("at").alias("created_at"), (F.col("ahead") + earlier).alias("ahead"), "moved")
    return rows.join(places, "created_at", "left")


def _to_send(state: State, changes: DataFrame, n: int, schema: str) -> DataFrame:
    """The jobs to send in tick ``n`` with ``ahead``: queued ones, and the others that changed or run."""
    running = state.spark.read.schema(schema).parquet(state.place("running", n)).withColumn("ahead", F.lit(None).cast("bigint"))
    first = _earliest(changes)
    if first is None:
        return running
    span = int(first // SPAN_SEC)
    earlier = state.counts(n).filter(F.col("range") < span * SPAN_SEC // RANGE_SEC).agg(F.sum("change")).first()[0] or 0
    rows = (state.jobs(n, schema, (F.col("span") >= span) | (F.col("span") == NO_SPAN))
            .join(changes.select("id", "was", "_created_at", "changed"), "id", "left").withColumn("now", _active()))
    rows = rows.withColumns({"_created_at": F.when(F.col("was").isNull(), F.col("created_at")).otherwise(F.col("_created_at")),
                             "was": F.coalesce("was", "now")})
    queued = F.coalesce(F.col("status") == "queued", F.lit(False))
    placed = _positions(rows, earlier).filter(F.col("changed") | (queued & (F.col("moved") != 0)))
    return (placed.filter(~F.coalesce(F.col("status") == "running", F.lit(False)))
            .withColumn("ahead", F.when(queued, F.col("ahead"))).select(*running.columns).unionByName(running))


def stream_feed(events: DataFrame, out: str, state: str, checkpoint: str, clock: Callable[[], float] = time.time,
                every: str | None = None) -> StreamingQuery:
    """Store the rows to send in each tick under ``out/batch=<n>``, one batch of ``events`` being one tick.

    Rows are serialized, with ``session_id`` for routing. ``state/ticks`` tells whether any job runs. Every job of
    a session is followed, without a limit to the newest. An event of a job whose creation has not been seen gives a
    row without a place in the queue.
    """
    spark = events.sparkSession
    store = State(spark, state)

    def tick(changed: DataFrame, n: int) -> None:
        with passing(spark):
            # stored first: everything below reads it several times, the stateful fold must run only once
            store.store(changed.withColumn("span", _span("created_at")), "rows", n, ("span",))
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changed.schema) + ", span bigint"
            delta = spark.read.schema(schema).parquet(store.place("rows", n))
            before = None
            if n:
                spans = F.col("span") >= (delta.agg(F.min("span")).first()[0] or 0)
                before = (store.jobs(n - 1, schema, spans | (F.col("span") == NO_SPAN))
                          .join(delta.select("id"), "id", "left_semi"))
            changes = freeze(_changes(delta, before), "changes")
            store.store(_count_changes(changes), "counts", n)
            running = delta.filter("status = 'running'")
            if n:
                kept = spark.read.schema(schema).parquet(store.place("running", n - 1)).join(delta, "id", "left_anti")
                running = running.unionByName(kept)
            store.store(running, "running", n)
            rows = _to_send(store, changes, n, schema).withColumn("progress", progress(clock()))
            rows.drop("result_dir", "span").write.mode("overwrite").parquet(f"{out}/batch={n}")
            busy = spark.read.parquet(store.place("running", n)).limit(1).count() > 0
            store.store(spark.range(1).select(F.lit(busy).alias("busy")), "ticks", n)
            store.fold(n, schema)

    return start(fold_jobs(events), checkpoint, "update", tick, every)


def session_frames(spark: SparkSession, out: str, state: str, sessions: DataFrame, tick: int) -> DataFrame:
    """What each of ``sessions`` (``session_id``) gets in a tick: ``session_id, n_rows, busy, frame``.

    ``frame`` is data where rows are sent or where it changed whether any job runs, else a keep-alive. The rows
    themselves are those of ``out/batch=<tick>``, as JSON by ``operators.feed.to_json_rows``.
    """
    def busy(n: int) -> bool | None:
        return spark.read.parquet(f"{state}/ticks/tick={n}").first()[0] if n >= 0 else None
    now, turned = busy(tick), busy(tick) != busy(tick - 1)
    counts = spark.read.parquet(f"{out}/batch={tick}").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    return sessions.join(counts, "session_id", "left").select(
        "session_id", rows.alias("n_rows"), F.lit(now).alias("busy"),
        F.when((rows > 0) | F.lit(turned), "data").otherwise("keepalive").alias("frame"))
