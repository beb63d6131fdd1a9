"""The change feed tick by tick against a plain simulation of a server that compares all rows."""

import random

import pytest

from doclake.operators.feed import to_json_rows
from doclake.streaming import change_feed

EVENT = ("id string, seq long, op string, status string, started_at double, finished_at double, error string, result_dir string, "
         "n_tables int, n_images int, session_id string, filename string, sha256 string, opts_hash string, page_total int, created_at double")
FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def event(**fields):
    return tuple(fields.get(f) for f in FIELDS)


def create(job, seq, at, session="s1"):
    return event(id=job, seq=seq, op="create", status="queued", session_id=session, filename=f"{job}.pdf", sha256="aa", opts_hash="oo",
                 page_total=10, created_at=at)


def claim(job, seq, at):
    return event(id=job, seq=seq, op="claim", status="running", started_at=at)


def finish(job, seq, at, status="done"):
    return event(id=job, seq=seq, op="finish", status=status, finished_at=at, result_dir="r/x")


def simulate(ticks):
    """Per tick, what is sent: (id, status, finished_at, ahead)."""
    jobs, seen, out = {}, {}, []
    for events in ticks:
        for e in sorted((dict(zip(FIELDS, e)) for e in events), key=lambda e: e["seq"]):
            job = jobs.setdefault(e["id"], {"status": None, "finished_at": None, "created_at": None, "session_id": None})
            job["status"] = e["status"]
            if e["op"] == "finish":
                job["finished_at"] = e["finished_at"]
            if e["op"] == "create":
                job["created_at"], job["session_id"] = e["created_at"], e["session_id"]
        active = [j["created_at"] for j in jobs.values() if j["status"] in ("queued", "running")]
        sent = set()
        for i, j in jobs.items():
            ahead = sum(a < j["created_at"] for a in active) if j["status"] == "queued" else None
            key = (j["status"], j["finished_at"], ahead)
            if seen.get(i) != key or j["status"] == "running":
                seen[i] = key
                sent.add((i, *key))
        out.append((sent, any(j["status"] == "running" for j in jobs.values()), {j["session_id"] for j in jobs.values()}))
    return out


def run(spark, ticks, tmp_path):
    """One run of the stream per tick, from the checkpoint of the run before."""
    src, out, state, progress = (f"file://{tmp_path}/{x}" for x in ("src", "out", "state", "progress"))
    for n, events in enumerate(ticks):
        spark.createDataFrame(events, EVENT).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENT).parquet(src)
        change_feed.stream_feed(stream, out, state, progress, clock=lambda: 9_000.0).awaitTermination()
    return out, state


def compare(spark, ticks, out, state):
    for n, (sent, busy, sessions) in enumerate(simulate(ticks)):
        rows = spark.read.parquet(f"{out}/batch={n}")
        got = [(r.id, r.status, r.finished_at, r.ahead) for r in rows.collect()]
        assert len(got) == len(set(got)) and set(got) == sent, n
        assert spark.read.parquet(f"{state}/ticks/tick={n}").first()[0] == busy


@pytest.fixture
def small_state(monkeypatch):
    monkeypatch.setattr(change_feed, "FOLD_EVERY", 3)
    monkeypatch.setattr(change_feed, "SPAN_SEC", 120)


def test_random_logs_over_many_ticks(spark, tmp_path, small_state):
    rng = random.Random(5)
    made, ticks, seq, status = [], [], 0, {}
    for n in range(9):
        events = []
        for _ in range(rng.choice([0, 3, 12]) if n else 20):
            seq += 1
            job = f"j{len(made)}"
            # hot instants, and jobs that arrive late
            made.append(job)
            status[job] = "queued"
            events.append(create(job, seq, float(rng.choice([60, 61, 500, 1000 + n * 50, rng.randint(0, 2000)])), f"s{rng.choice([0, 0, 0, 1, 2])}"))
        for job in rng.sample(made, min(len(made), rng.choice([1, 4, 8]))):
            seq += 1
            if status[job] == "queued":
                status[job] = "running"
                events.append(claim(job, seq, 100.0 + n))
            elif status[job] == "running":
                status[job] = rng.choice(["done", "failed", "queued"])
                events.append(finish(job, seq, 200.0 + n, status[job]) if status[job] != "queued"
                              else event(id=job, seq=seq, op="requeue", status="queued"))
        ticks.append(events)
    ticks = [t for t in ticks if t]
    out, state = run(spark, ticks, tmp_path)
    compare(spark, ticks, out, state)


def test_frames_of_sessions(spark, tmp_path):
    ticks = [[create("a", 1, 10.0, "s1"), create("b", 2, 20.0, "s2"), claim("a", 3, 11.0)],
             [finish("a", 4, 30.0)], [create("c", 5, 40.0, "s3")]]
    out, state = run(spark, ticks, tmp_path)
    compare(spark, ticks, out, state)
    sessions = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("idle",)], "session_id string")
    frames = [{r.session_id: (r.n_rows, r.busy, r.frame) for r in change_feed.session_frames(spark, out, state, sessions, n).collect()}
              for n in range(3)]
    assert frames[0] == {"s1": (1, True, "data"), "s2": (1, True, "data"), "s3": (0, True, "data"), "idle": (0, True, "data")}
    # the worker went idle: everyone hears of it; b moved up
    assert frames[1] == {"s1": (1, False, "data"), "s2": (1, False, "data"), "s3": (0, False, "data"), "idle": (0, False, "data")}
    assert frames[2] == {"s1": (0, False, "keepalive"), "s2": (0, False, "keepalive"), "s3": (1, False, "data"),
                         "idle": (0, False, "keepalive")}
    row = to_json_rows(spark.read.parquet(f"{out}/batch=2")).first()
    assert '"ahead":1' in row.json and '"result_dir"' not in row.json and '"error":null' in row.json


def test_a_tick_writes_what_changed(spark, tmp_path, small_state):
    """A change at the end of the queue leaves earlier jobs unread and unwritten."""
    ticks = [[create(f"j{i}", i, float(i)) for i in range(1000)], [create("last", 5000, 5000.0)], [claim("last", 5001, 5001.0)]]
    out, state = run(spark, ticks, tmp_path)
    compare(spark, ticks, out, state)
    assert spark.read.parquet(f"{out}/batch=1").count() == 1
    assert spark.read.parquet(f"{state}/rows/tick=1").count() == 1 and spark.read.parquet(f"{state}/counts/tick=1").count() == 1
    late = change_feed.State(spark, state).jobs(1, spark.read.parquet(f"{state}/rows/tick=1").schema.simpleString()[7:-1].replace(":", " "),
                                                change_feed.F.col("span") >= 40)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and late.count() == 1


def test_a_repeated_tick_gives_the_same_rows(spark, tmp_path, small_state):
    ticks = [[create("a", 1, 10.0), create("b", 2, 200.0)], [claim("a", 3, 11.0)], [finish("a", 4, 30.0)], [create("c", 5, 5.0)]]
    out, state = run(spark, ticks, tmp_path)
    compare(spark, ticks, out, state)
    before = {n: sorted(map(str, spark.read.parquet(f"{out}/batch={n}").collect())) for n in range(4)}
    # forget that the last tick, and the one that folded the log, were done
    for n in (2, 3):
        delta = spark.read.parquet(f"{state}/rows/tick={n}").drop("span")
        stored = spark.createDataFrame(delta.collect(), delta.schema)
        handle = {}
        original = change_feed.start
        try:
            change_feed.start = lambda df, checkpoint, mode, tick, every: handle.setdefault("tick", tick)
            change_feed.stream_feed(spark.createDataFrame([], EVENT), out, state, "", clock=lambda: 9_000.0)
        finally:
            change_feed.start = original
        handle["tick"](stored, n)
    assert {n: sorted(map(str, spark.read.parquet(f"{out}/batch={n}").collect())) for n in range(4)} == before


def test_a_tick_writes_few_files(spark, tmp_path, small_state):
    """Their number is that of spans and tasks together, not spans times tasks."""
    ticks = [[create(f"j{i}", i, float(i)) for i in range(1200)], [claim(f"j{i}", 2000 + i, 3000.0) for i in range(0, 1200, 3)]]
    out, state = run(spark, ticks, tmp_path)
    compare(spark, ticks, out, state)
    for n in range(2):
        files = list((tmp_path / "state" / "rows" / f"tick={n}").glob("span=*/*.parquet"))
        assert len({f.parent for f in files}) == 10 and len(files) < 10 + 8
