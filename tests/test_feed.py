from pyspark.sql import functions as F

from doclake.operators import feed, jobs


def _ahead(df):
    return jobs.with_ahead(df)


def test_positions_that_shrink_are_sent_again(job_rows):
    three = [dict(id=f"j{i}", created_at=100.0 * (i + 1)) for i in range(3)]
    prev = _ahead(job_rows(*three))
    curr = _ahead(job_rows({**three[0], "status": "done", "finished_at": 9.0}, three[1], three[2]))
    sent = {r.id: r.ahead for r in feed.diff_snapshots(prev, curr).collect()}
    assert sent == {"j0": None, "j1": 0, "j2": 1}
    assert feed.diff_snapshots(curr, curr).count() == 0


def test_unchanged_done_rows_stay_home_and_running_rows_do_not(job_rows):
    rows = [dict(id="q", created_at=100.0), dict(id="d", status="done", created_at=200.0, finished_at=201.0),
            dict(id="r", status="running", created_at=300.0)]
    prev = _ahead(job_rows(*rows))
    curr = _ahead(job_rows({**rows[0], "status": "done", "finished_at": 9.0}, *rows[1:]))
    assert sorted(r.id for r in feed.diff_snapshots(prev, curr).collect()) == ["q", "r"]
    fresh = feed.diff_snapshots(prev.limit(0), curr)
    assert fresh.count() == 3


def test_frames(job_rows):
    idle = job_rows(dict(id="d", status="done"))
    nothing, busy = _ahead(idle).limit(0), jobs.is_busy(idle)
    assert feed.feed_frame(nothing, busy, None).first().frame == "data"
    assert feed.feed_frame(nothing, busy, False).first().frame == "keepalive"
    assert feed.feed_frame(nothing, busy, True).first().frame == "data"
    one = feed.feed_frame(_ahead(idle), busy, False).first()
    assert (one.frame, one.n_rows, one.busy) == ("data", 1, False)
    assert feed.to_json_rows(idle.select("id", "error")).first().json == '{"id":"d","error":null}'


def test_delta_and_full(job_rows):
    state = job_rows(dict(id="a"), dict(id="b", status="running"), dict(id="c"))
    delta = job_rows(dict(id="b", status="done"), dict(id="n"))
    merged = {r.id: r.status for r in feed.apply_delta(state, delta).collect()}
    assert merged == {"a": "queued", "b": "done", "c": "queued", "n": "queued"}
    assert [r.id for r in feed.settled(state, delta).collect()] == ["b"]
    assert feed.settled(delta, delta).count() == 0
    full = {r.id: r.change for r in feed.apply_full(state, feed.apply_delta(state, delta).filter("id <> 'c'")).collect()}
    assert full == {"a": "same", "b": "changed", "c": "removed", "n": "added"}


def test_changed_fields(spark):
    schema = "id string, status string, label string, progress int, error string"
    def shown(**r):
        return spark.createDataFrame([("x", r["status"], r["label"], r.get("progress", 0), r.get("error"))], schema)
    def changes(a, b):
        return feed.changed_fields(a, b).select(F.array_join("fields", ",")).first()[0]
    done = shown(status="done", label="완료", progress=100)
    queued, nearer = shown(status="queued", label="앞에 2개 대기"), shown(status="queued", label="앞에 1개 대기")
    running, further = (shown(status="running", label=f"{p}%", progress=p) for p in (40, 41))
    assert changes(done, done) == ""
    assert changes(queued, nearer) == "label"
    assert changes(nearer, running) == "class,label,bar"
    assert changes(running, further) == "label,bar"
    assert changes(further, done) == "class,label,bar,chip"
    assert changes(running, shown(status="failed", label="실패", error="x")) == "class,label,bar,error"


def test_of_several_changes_the_latest_counts(spark):
    state = spark.createDataFrame([("a", "queued"), ("b", "queued")], "id string, status string")
    delta = spark.createDataFrame([("a", "done", 3), ("a", "running", 2), ("c", "queued", 1)], "id string, status string, tick int")
    got = sorted(tuple(r) for r in feed.apply_delta(state, delta, "tick").collect())
    assert got == [("a", "done"), ("b", "queued"), ("c", "queued")]
