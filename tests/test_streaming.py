import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from doclake.operators import jobs
from doclake.operators.admission import admit
from doclake.plans import derived as D
from doclake.sources.scratch import scratch_path
from doclake.streaming import feeds

from conftest import SMALL


def _in_batches(spark, df, order, tmp_path, n=3):
    """Store ``df`` as ``n`` files in ``order`` and stream one file per batch."""
    src = str(tmp_path / "src")
    ranked = df.withColumn("_part", F.ntile(n).over(Window.orderBy(*order)))
    for i in range(1, n + 1):
        ranked.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_fold_over_batches_equals_the_batch_fold(spark, tmp_path):
    events = D.job_events(spark, SMALL)
    stream = feeds.stream_fold(_in_batches(spark, events, ["seq", "id"], tmp_path))
    out = str(tmp_path / "out")
    feeds.stream_to_batches(stream, out, str(tmp_path / "ckpt"), "update").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.select("batch").distinct().count() == 3
    final = feeds.latest(stored, ["id"])
    expected = jobs.fold_jobs(events)
    assert final.select(expected.columns).exceptAll(expected).count() == 0 and final.count() == expected.count()


def test_feed_over_batches_rebuilds_the_table(spark, tmp_path):
    events = D.job_events(spark, SMALL)
    stream = _in_batches(spark, events, ["seq", "id"], tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    feeds.stream_feed(stream, out, state, str(tmp_path / "ckpt")).awaitTermination()
    frames = spark.read.parquet(out)
    assert frames.select("batch").distinct().count() == 3
    # a client that applies all frames holds the state, queue positions included
    client = feeds.latest(frames, ["id"]).select("id", "status", "finished_at", "ahead")
    expected = jobs.with_ahead(jobs.fold_jobs(events)).select("id", "status", "finished_at", "ahead")
    assert client.filter("status <> 'running'").exceptAll(expected.filter("status <> 'running'")).count() == 0
    assert client.count() == expected.count()


def test_admission_over_batches_respects_the_quota(spark, tmp_path):
    ups, pages, known = D.uploads(spark, SMALL), D.page_text(spark, SMALL), D.jobs(spark, SMALL)
    out = str(tmp_path / "out")
    feeds.stream_admit(_in_batches(spark, ups, ["arrival"], tmp_path), pages, known, out, str(tmp_path / "ckpt"),
                       D.NOW_LIVE).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.select("batch").distinct().count() == 3
    once = admit(ups, pages, known, D.NOW_LIVE)
    assert stored.select(once.columns).exceptAll(once).count() == 0 and stored.count() == once.count()


def test_dedup_and_retention(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def hours(h):
        return t0 + dt.timedelta(hours=h)

    rows = [("a", "x", "o", hours(0)), ("b", "x", "o", hours(1)), ("c", "y", "o", hours(2)),
            ("d", "z", "o", hours(60)), ("e", "z", "o", hours(61)), ("h", "v", "o", hours(62)),
            ("f", "x", "o", hours(80)), ("g", "w", "o", hours(3))]
    df = spark.createDataFrame(rows, "id string, sha256 string, opts_hash string, created timestamp")
    src = str(tmp_path / "src")
    for part in (rows[:3], rows[3:5], rows[5:6], rows[6:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    feeds.stream_to_batches(feeds.stream_dedup(stream), out, str(tmp_path / "c1")).awaitTermination()
    # x may be converted again after its entry has expired; the late row g is older than the retention time
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "c", "d", "f", "h"]
    kept = str(tmp_path / "kept")
    feeds.stream_to_batches(feeds.stream_retain(stream), kept, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(kept).collect()) == ["a", "b", "c", "d", "e", "f", "h"]


def test_sweep(spark, job_rows):
    df = job_rows(dict(id="old", created_at=1.0), dict(id="new", created_at=90_000.0))
    kept, dropped = scratch_path(spark, "kept"), scratch_path(spark, "dropped")
    feeds.sweep(df, 100_000.0, kept, dropped)
    assert [r.id for r in spark.read.parquet(kept).collect()] == ["new"]
    assert [r.id for r in spark.read.parquet(dropped).collect()] == ["old"]


def test_files_are_admitted_as_they_arrive(spark, tmp_path, job_rows):
    """Size before body, magic bytes, hash, quota against the job table as it is then, and the cache."""
    import hashlib
    from doclake import constants as C
    from doclake.operators.cache import options
    opts = options(spark).first().opts_hash
    root, out = tmp_path / "in", f"file://{tmp_path}/out"
    pdf = lambda text: b"%PDF-1.7\n" + text.encode()
    sha = lambda body: hashlib.sha256(body).hexdigest()

    def arrive(session, name, body, opts_hash=opts):
        folder = root / f"session={session}" / f"opts={opts_hash}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)

    def known(status):
        full = [dict(id=f"f{i}", session_id="full", status=status) for i in range(C.MAX_QUEUED_PER_SESSION)]
        return job_rows(*full, dict(id="c", status="done", sha256=sha(pdf("cached")), opts_hash=opts, result_dir="r/c", n_tables=1, n_images=2))

    bodies = [pdf(x) for x in ("good", "cached", "late", "empty", "broken")]
    pages = spark.createDataFrame([(sha(b), i, "enough text here") for b in bodies[:3] for i in range(2)], "sha256 string, page_no int, text string")
    broken = spark.createDataFrame([(sha(bodies[4]),)], "sha256 string")

    def run(jobs):
        files = feeds.stream_files(spark, f"file://{root}")
        feeds.stream_admit_files(files, lambda: pages, jobs, out, f"file://{tmp_path}/progress", clock=lambda: 7.0,
                                 broken=lambda: broken).awaitTermination()

    for name, body in zip(("good.pdf", "cached.pdf", "x", "empty.pdf", "broken.pdf"), bodies):
        if name != "x":
            arrive("s1", name, body)
    arrive("s1", "note.txt", b"hello")
    arrive("s1", "odd.pdf", bodies[0], "unknown")
    arrive("full", "good.pdf", bodies[0])
    run(lambda: known("queued"))
    # the jobs of the full session have ended in the meantime; copies of one body are both queued
    arrive("full", "late.pdf", bodies[2])
    arrive("s2", "late.pdf", bodies[2])
    run(lambda: known("done"))
    rows = {(r.batch, r.session_id, r.filename): r for r in spark.read.parquet(out).collect()}
    state = {k: (r.status, r.error) for k, r in rows.items()}
    m = C.REJECT_MESSAGES
    assert state == {
        (0, "s1", "good.pdf"): ("queued", None), (0, "s1", "cached.pdf"): ("done", None), (0, "s1", "empty.pdf"): ("failed", m["empty"]),
        (0, "s1", "broken.pdf"): ("failed", m["broken"]), (0, "s1", "note.txt"): ("failed", m["not_pdf"]),
        (0, "full", "good.pdf"): ("failed", m["over_quota"]), (1, "full", "late.pdf"): ("queued", None), (1, "s2", "late.pdf"): ("queued", None)}
    assert rows[0, "s1", "cached.pdf"].result_dir == "r/c" and rows[0, "s1", "good.pdf"].page_total == 2
    assert rows[0, "s1", "good.pdf"].sha256 == sha(bodies[0]) and rows[0, "s1", "note.txt"].sha256 == "-"


def test_entries_live_on_from_their_last_use(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "x", 0), ("b", "x", 20), ("c", "x", 43), ("d", "y", 1), ("e", "x", 68), ("f", "y", 26), ("g", "z", 200), ("h", "x", 5)]
    schema = "id string, sha256 string, opts_hash string, created timestamp"
    uses = [(i, s, "o", t0 + dt.timedelta(hours=h)) for i, s, h in rows]
    src, out, progress = (f"file://{tmp_path}/{x}" for x in ("src", "out", "progress"))
    for part in (uses[:4], uses[4:6], uses[6:7], uses[7:]):        # h comes when its time has long been closed
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        feeds.stream_to_batches(feeds.stream_entries(stream, "30 hours"), out, progress).awaitTermination()
    got = sorted((r.sha256, r.first_id, r.n_uses, (r.expires - t0).total_seconds() / 3600) for r in spark.read.parquet(out).collect())
    # 20 and 23 hours renew, 25 hours do not
    assert got == [("x", "a", 3, 67.0), ("x", "e", 1, 92.0), ("y", "d", 1, 25.0), ("y", "f", 1, 50.0)]
    table = feeds.stream_entries(spark.createDataFrame(uses[:7], schema))
    assert sorted((r.sha256, r.first_id, r.n_uses) for r in table.collect()) == [
        ("x", "a", 3), ("x", "e", 1), ("y", "d", 1), ("y", "f", 1), ("z", "g", 1)]
