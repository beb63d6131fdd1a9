"""Stored job tables: no shuffle by id, no reading of what did not change, no ordering for a few rows."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators import feed, jobs, queue_index
from doclake.sources import snapshots
from doclake.streaming import feeds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _name(kind):
    return f"{kind}_{uuid.uuid4().hex}"


def test_bucketed_tables_fold_and_diff_without_exchange(spark, job_rows):
    none = (None,) * 6
    log = [(f"j{i}", s, op, status, None, None, None, None, None, None, *none) for i in range(300)
           for s, op, status in ((1, "create", "queued"), (2, "claim", "running"), (3, "finish", "done"))[:1 + i % 3]]
    events = spark.createDataFrame(log, "id string, seq long, op string, status string, started_at double, finished_at double, error string, "
                                        "result_dir string, n_tables int, n_images int, session_id string, filename string, sha256 string, "
                                        "opts_hash string, page_total int, created_at double")
    stored = snapshots.write_bucketed(events, _name("events"), 4)
    folded = jobs.fold_jobs(stored)
    assert "Exchange" not in _plan(folded)
    assert folded.exceptAll(jobs.fold_jobs(events)).count() == 0 and folded.count() == 300
    prev = jobs.with_ahead(job_rows(*[dict(id=f"j{i}") for i in range(50)]))
    curr = jobs.with_ahead(job_rows(*[dict(id=f"j{i}", status="done" if i % 7 == 0 else "queued") for i in range(10, 60)]))
    a, b = (snapshots.write_bucketed(df, _name("jobs"), 4) for df in (prev, curr))
    for diff in (feed.diff_snapshots, feed.apply_full, lambda x, y: feed.apply_delta(x, y)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            got = diff(a, b)
            assert "Exchange" not in _plan(got)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got.exceptAll(diff(prev, curr)).count() == 0 and got.count() == diff(prev, curr).count()


def test_digests_lead_to_the_folders_that_differ(spark, job_rows, tmp_path):
    rng = random.Random(1)
    base = [dict(id=f"j{i}", page_total=rng.randint(1, 9), error=rng.choice([None, "", "x"])) for i in range(2_000)]
    old, new, same = (str(tmp_path / x) for x in ("old", "new", "same"))
    later = [dict(r) for r in base if r["id"] != "j5"] + [dict(id="fresh")]
    later[99] = {**later[99], "status": "done"}
    snapshots.write_snapshot(job_rows(*base), old, folders=500)
    snapshots.write_snapshot(job_rows(*later).repartition(7), new, folders=500)
    snapshots.write_snapshot(job_rows(*base[::-1]).repartition(3), same, folders=500)
    assert snapshots.changed_folders(spark, old, same) == []
    folders = snapshots.changed_folders(spark, old, new)
    assert 1 <= len(folders) <= 3
    a, b = snapshots.read_changed(spark, old, new)
    assert a.count() < 40 and "PartitionFilters: [folder" in _plan(a)
    got = {r.id: r.change for r in feed.apply_full(a, b).collect() if r.change != "same"}
    assert got == {"j5": "removed", "fresh": "added", later[99]["id"]: "changed"}
    # rows that stand twice, or trade places between null and empty, do not cancel out
    snapshots.write_snapshot(job_rows(*base, base[3], base[3]), new, folders=500)
    assert len(snapshots.changed_folders(spark, old, new)) == 1


def test_index_gives_the_places_of_the_whole_queue(spark, job_rows, tmp_path):
    rng = random.Random(2)
    rows = [dict(id=f"j{i}", session_id=f"s{i % 9}", status=rng.choice(["queued", "queued", "running", "done"]),
                 created_at=float(rng.choice([50, 60, 61, 61, 3_700, rng.randint(0, 9_000)])), page_total=rng.choice([None, 0, 3])) for i in range(400)]
    df = job_rows(*rows)
    path = str(tmp_path / "queue")
    queue_index.build_queue_index(df, path)
    active = [r for r in rows if r["status"] in ("queued", "running")]
    want = {}
    for r in rows:
        if r["status"] == "queued":
            earlier = [a for a in active if a["created_at"] < r["created_at"]]
            want[r["id"]] = (len(earlier), sum(a["page_total"] or 1 for a in earlier))
    assert {r.id: (r.ahead, r.pages_ahead) for r in queue_index.places(df, path).collect()} == want
    view = queue_index.indexed_view(df, path, 9_999.0, session="s4", limit=20)
    got = view.collect()
    assert len(got) == 20 and all((r.ahead, r.pages_ahead) == want.get(r.id, (None, None)) for r in got)
    assert all(r.wait_sec == (None if r.pages_ahead is None else r.pages_ahead * C.SEC_PER_PAGE) for r in got)
    assert "Window" not in _plan(view)


def test_state_of_ended_jobs_is_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = ("id string, seq long, op string, status string, started_at double, finished_at double, error string, result_dir string, "
              "n_tables int, n_images int, session_id string, filename string, sha256 string, opts_hash string, page_total int, "
              "created_at double, at timestamp")

    def event(job, seq, op, status, hour):
        return (job, seq, op, status, None, float(hour) if op == "finish" else None, None, None, None, None, "s", "f", "h", "o", 1,
                float(hour) if op == "create" else None, t0 + dt.timedelta(hours=hour))
    lots = [[event(f"a{i}", 1, "create", "queued", 0) for i in range(100)] + [event("a0", 2, "claim", "running", 1)],
            [event("a0", 3, "finish", "done", 20), event("b", 1, "create", "queued", 30)],
            [event("c", 1, "create", "queued", 60)],
            [event("a1", 2, "finish", "done", 2), event("d", 1, "create", "queued", 61)]]      # a1 ended long ago
    src, out, progress = (f"file://{tmp_path}/{x}" for x in ("src", "out", "progress"))
    held = []
    for lot in lots:
        spark.createDataFrame(lot, schema).write.mode("append").parquet(src)
        stream = feeds.stream_expired(spark.readStream.schema(schema).parquet(src), "2 hours")
        query = feeds.stream_to_batches(stream, out, progress)
        query.awaitTermination()
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    got = {r.id: (r.status, (r.expires - t0).total_seconds() / 3600) for r in spark.read.parquet(out).collect()}
    assert got == {**{f"a{i}": ("queued", 24.0) for i in range(1, 100)}, "a0": ("done", 44.0), "b": ("queued", 54.0)}
    assert held[0] >= 100 and held[-1] <= 3
