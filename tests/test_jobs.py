
from doclake import constants as C
from doclake.operators import cache, jobs, reports


def ids(df):
    return [r.id for r in df.collect()]


def test_fold_keeps_counts_when_a_second_finish_has_none(spark):
    schema = ("id string, seq int, op string, status string, started_at double, finished_at double, error string, "
              "result_dir string, n_tables int, n_images int, session_id string, filename string, sha256 string, "
              "opts_hash string, page_total int, created_at double")
    none = [None] * 6
    log = spark.createDataFrame([
        ("j1", 1, "create", "queued", None, None, None, None, None, None, "s1", "f.pdf", "x", "o", 3, 1.0),
        ("j1", 2, "claim", "running", 5.0, None, None, None, None, None, *none),
        ("j1", 3, "finish", "done", None, 9.0, "odd", "r/x-o", 3, 5, *none),
        ("j1", 4, "finish", "done", None, 11.0, None, None, None, None, *none),
        ("j2", 1, "create", "queued", None, None, None, None, None, None, "s1", "g.pdf", "y", "o", 1, 2.0),
        ("j2", 2, "claim", "running", 6.0, None, None, None, None, None, *none),
        ("j2", 3, "requeue", "queued", None, None, None, None, None, None, *none),
        ("j2", 4, "claim", "running", 7.0, None, None, None, None, None, *none),
        ("j2", 5, "requeue", "queued", None, None, None, None, None, None, *none),
    ], schema)
    j1, j2 = jobs.fold_jobs(log).orderBy("id").collect()
    assert (j1.n_tables, j1.n_images, j1.result_dir, j1.finished_at, j1.error, j1.attempts) == (3, 5, "r/x-o", 11.0, None, 0)
    assert (j2.status, j2.started_at, j2.attempts, j2.page_total) == ("queued", None, 2, 1)


def test_lists_are_private_and_newest_first(job_rows):
    df = job_rows(dict(id="a", created_at=1.0), dict(id="b", created_at=3.0), dict(id="c", session_id="s2", created_at=2.0))
    assert ids(jobs.list_jobs(df, "s1")) == ["b", "a"]
    assert ids(jobs.list_jobs(df, admin=True)) == ["b", "c", "a"]
    assert ids(jobs.list_jobs(df, admin=True, limit=1)) == ["b"]


def test_owned(spark, job_rows):
    df = job_rows(dict(id="a", status="done"), dict(id="b"), dict(id="c", status="done", session_id="s2"))
    requests = spark.createDataFrame([("1", "a", "s1", False), ("2", "b", "s1", False), ("3", "c", "s1", False),
                                      ("4", "c", "x", True), ("5", "zz", "x", True)],
                                     "request_id string, id string, session_id string, admin boolean")
    assert sorted(r.request_id for r in jobs.owned(df, requests).collect()) == ["1", "4"]


def test_ahead_counts_strictly_earlier_active_jobs(job_rows):
    df = job_rows(dict(id="q1", created_at=7.5), dict(id="r", created_at=31.0, status="running"),
                  dict(id="d", created_at=2.0, status="done"), dict(id="q2", created_at=88.25),
                  dict(id="q3", created_at=88.25))
    assert {r.id: r.ahead for r in jobs.with_ahead(df).collect()} == {"q1": 0, "r": None, "d": None, "q2": 2, "q3": 2}


def test_progress(job_rows):
    df = job_rows(dict(id="done", status="done"), dict(id="new"), dict(id="half", status="running", started_at=100.0, page_total=40),
                  dict(id="late", status="running", started_at=1.0), dict(id="nopages", status="running", started_at=129.7, page_total=None),
                  dict(id="nostart", status="running"), dict(id="future", status="running", started_at=160.0, page_total=40))
    got = {r.id: r.progress for r in jobs.with_progress(df, 130.0).collect()}
    assert got == {"done": 100, "new": 0, "half": 50, "late": 95, "nopages": 20, "nostart": 0, "future": -50}


def test_busy_and_queue(job_rows):
    df = job_rows(dict(id="b", created_at=2.0), dict(id="a", created_at=2.0), dict(id="c", created_at=1.0, status="done"))
    assert jobs.is_busy(df).first().busy is False
    assert jobs.is_busy(df.limit(0)).first().busy is False
    assert ids(jobs.next_in_line(df)) == ["a"]
    assert jobs.queued_counts(df).first().n_queued == 2


def test_requeue_and_quarantine(job_rows):
    df = job_rows(dict(id="r", status="running", started_at=4.0), dict(id="q"), dict(id="d", status="done", started_at=4.0))
    back = {r.id: r for r in jobs.requeue_running(df).collect()}
    assert (back["r"].status, back["r"].started_at, back["r"].attempts) == ("queued", None, 1)
    assert (back["d"].started_at, back["d"].attempts) == (4.0, 0)
    end = {r.id: r for r in jobs.quarantine(jobs.requeue_running(df), 9.0).collect()}
    assert (end["r"].status, end["r"].error, end["r"].finished_at) == ("failed", C.POISON_MESSAGE, 9.0)
    assert end["q"].status == "queued"


def test_sweep_keeps_files_of_live_jobs(spark, job_rows):
    now = 100_000.0
    df = job_rows(dict(id="old", sha256="OLD", result_dir="r/OLD-o", created_at=now - C.RETENTION_SEC - 10),
                  dict(id="old2", sha256="SHARED", result_dir="r/SHARED-o", created_at=now - C.RETENTION_SEC - 10),
                  dict(id="live", sha256="SHARED", result_dir="r/SHARED-o", created_at=now),
                  dict(id="edge", sha256="EDGE", created_at=now - C.RETENTION_SEC))
    assert sorted(ids(jobs.retain(df, now))) == ["edge", "live"]
    assert sorted(ids(jobs.expired(df, now))) == ["old", "old2"]
    files = spark.createDataFrame([("upload", "OLD"), ("upload", "SHARED"), ("upload", "EDGE"), ("result", "OLD-o"),
                                   ("result", "SHARED-o"), ("result", "STRAY-o")], "kind string, name string")
    assert sorted(map(tuple, jobs.orphan_files(files, df, now).collect())) == [
        ("result", "OLD-o"), ("result", "STRAY-o"), ("upload", "OLD")]


def test_labels(job_rows):
    df = job_rows(dict(id="a", created_at=1.0), dict(id="b", created_at=2.0), dict(id="r", status="running", started_at=5.0, created_at=1.5, page_total=40),
                  dict(id="d", status="done"), dict(id="f", status="failed"))
    got = {r.id: r.label for r in jobs.with_label(jobs.serialize(df, 35.0)).collect()}
    assert got == {"a": "곧 시작", "b": "앞에 2개 대기", "r": "50%", "d": "완료", "f": "실패"}


def test_session_summary(job_rows):
    df = job_rows(dict(id="a", status="done"), dict(id="b", status="done"), dict(id="c", session_id="s2", status="running"))
    got = {r.session_id: (r.my_running, r.n_done, r.offer_bulk, r.show_beat) for r in jobs.session_summary(df).collect()}
    assert got == {"s1": (False, 2, True, True), "s2": (True, 0, False, False)}


def test_cache(spark, job_rows):
    df = job_rows(dict(id="a", sha256="X", opts_hash="O", status="queued"),
                  dict(id="b", sha256="X", opts_hash="O", status="done", result_dir="r/1", n_tables=2, n_images=4, created_at=1.0),
                  dict(id="c", sha256="X", opts_hash="O", status="done", result_dir="r/2", n_tables=3, n_images=5, created_at=2.0))
    cached = cache.cached_results(df)
    assert [(r.cached_id, r.result_dir) for r in cached.collect()] == [("c", "r/2")]
    uploads = spark.createDataFrame([(1, "X", "O"), (2, "Y", "O"), (3, "X", "P"), (4, "Y", "O")],
                                    "upload_id int, sha256 string, opts_hash string")
    got = {r.upload_id: (r.status, r.n_tables) for r in cache.apply_cache(uploads, cached).collect()}
    assert got == {1: ("done", 3), 2: ("queued", None), 3: ("queued", None), 4: ("queued", None)}


def test_options(spark, job_rows):
    table = {(r.include_images, r.include_csv): r.opts_hash for r in cache.options(spark).collect()}
    assert table[(True, True)] == "83d3b74500a12a33" and len(set(table.values())) == 4
    newer = {r.opts_hash for r in cache.options(spark, 8).collect()}
    assert not newer & set(table.values())
    df = job_rows(dict(id="a", opts_hash=table[(True, False)]), dict(id="b", opts_hash="old"), dict(id="c", opts_hash="old", status="done"))
    got = {r.id: (r.include_images, r.include_csv, r.stale) for r in cache.decode_opts(df).collect()}
    assert got["a"] == (True, False, False) and got["b"] == (None, None, True)
    failed = {r.id: r.status for r in cache.fail_stale(df, 1.0).collect()}
    assert failed == {"a": "queued", "b": "failed", "c": "done"}
    assert ids(cache.invalidated(df, 7)) == ["c"]


def test_reports(job_rows):
    df = job_rows(dict(id="a", status="done", started_at=0.5, finished_at=30.5, page_total=20),
                  dict(id="hit", status="done", finished_at=9.0, page_total=500),
                  dict(id="q1", created_at=10.0, page_total=7), dict(id="q2", created_at=20.0, page_total=None),
                  dict(id="q3", created_at=30.0))
    assert reports.calibrate(df).first().sec_per_page == 1.5
    got = {r.id: (r.pages_ahead, r.wait_sec) for r in reports.wait_estimate(df).collect()}
    assert got == {"q1": (0, 0.0), "q2": (7, 10.5), "q3": (8, 12.0)}


def test_serialized_rows_hide_owner_and_paths(job_rows):
    columns = jobs.serialize(job_rows(dict(id="a")), 1.0).columns
    assert "session_id" not in columns and "result_dir" not in columns and {"progress", "ahead"} <= set(columns)
