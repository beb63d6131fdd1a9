"""Change feed: what a client has to learn between two states of the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_snapshots(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Rows of ``curr`` to send: new, running, or changed in status, end time or queue position.

    Both sides carry ``ahead``; it counts for queued rows only.
    """
    def key(df: DataFrame) -> Column:
        position = F.when(df["status"] == "queued", F.coalesce(df["ahead"], F.lit(0))).otherwise(F.lit(0))
        return F.struct(df["status"].alias("status"), df["finished_at"].alias("finished_at"),
                        position.cast("bigint").alias("position"))

    sent = prev.select("id", key(prev).alias("_sent"))
    return (curr.withColumn("_key", key(curr)).join(sent, "id", "left")
            .filter(~F.col("_key").eqNullSafe(F.col("_sent")) | (F.col("status") == "running"))
            .drop("_key", "_sent"))


def feed_frame(diff: DataFrame, busy: DataFrame, prev_busy: bool | None) -> DataFrame:
    """One row: how many rows the frame carries, the busy flag, and whether it is data or a keep-alive."""
    previous = "CAST(NULL AS boolean)" if prev_busy is None else str(bool(prev_busy)).lower()
    return diff.sparkSession.sql(
        f"""SELECT n_rows, busy, CASE WHEN n_rows > 0 OR NOT (busy <=> {previous}) THEN 'data'
                   ELSE 'keepalive' END AS frame
            FROM (SELECT (SELECT count(*) FROM {{diff}}) AS n_rows, busy FROM {{busy}})""", diff=diff, busy=busy)


def to_json_rows(diff: DataFrame) -> DataFrame:
    """One JSON object per row of the frame."""
    return diff.select("id", F.to_json(F.struct(*diff.columns), {"ignoreNullFields": "false"}).alias("json"))


def apply_delta(state: DataFrame, delta: DataFrame, tick: str | None = None) -> DataFrame:
    """Rows of ``delta`` replace rows of ``state`` with the same id; all others stay.

    ``tick`` names the column of ``delta`` that orders it: of several rows of one id the latest counts.
    """
    if tick:
        latest = F.max_by(F.struct(*state.columns), tick).alias("r")
        delta = delta.groupBy("id").agg(latest).select("r.*")
    return state.join(delta.select("id"), "id", "left_anti").select(*state.columns).unionByName(
        delta.select(*state.columns))


def apply_full(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """How a full snapshot changes the state: ``(id, change)`` with added, changed, removed or same."""
    fields = [c for c in state.columns if c != "id"]
    old = state.select("id", F.struct(*fields).alias("_old"))
    new = snapshot.select("id", F.struct(*fields).alias("_new"))
    return old.join(new, "id", "full_outer").select(
        "id", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "same")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed").alias("change"))


def settled(prev: DataFrame, delta: DataFrame) -> DataFrame:
    """Jobs known as unfinished before that are done now."""
    before = prev.select("id", F.col("status").alias("_before")).filter(F.col("_before") != "done")
    return delta.filter(F.col("status") == "done").join(before, "id").select("id")


def changed_fields(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Display fields that differ per job: ``(id, fields)``; an unchanged job has none."""
    def view(df: DataFrame, name: str) -> DataFrame:
        failed, running, done = (df["status"] == s for s in ("failed", "running", "done"))
        width = F.when(running, df["progress"]).when(done, 100).otherwise(0)
        return df.select("id", F.struct(
            df["status"].alias("class"), df["label"].alias("label"), width.alias("bar"),
            F.when(failed & (df["error"] != ""), df["error"]).alias("error"), done.alias("done")).alias(name))

    pair = view(prev, "a").join(view(curr, "b"), "id")
    changed = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in ("class", "label", "bar", "error")]
    chip = F.when(F.col("b.done") & ~F.col("a.done"), "chip")    # the result chip is made once and then kept
    return pair.select("id", F.array_compact(F.array(*changed, chip)).alias("fields"))
