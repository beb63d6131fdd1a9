from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators import admission
from doclake.sources import uploads as up


def test_probe_samples_evenly(spark):
    rows = [("short", i, f" {'x' * (i + 1)} \n") for i in range(3)]
    rows += [("n24", i, "ab") for i in range(24)] + [("n23", i, "a") for i in range(23)] + [("blank", 0, " \t\n")]
    got = {r.doc_id: (r.n_pages, r.text_chars) for r in admission.text_probe(
        spark.createDataFrame(rows, "doc_id string, page_no int, text string")).collect()}
    assert got == {"short": (3, 6), "n24": (24, 24), "n23": (23, 23), "blank": (1, 0)}


def _uploads(spark, *rows):
    base = dict(session_id="s1", filename="a.pdf", length=10, is_pdf=True, broken=False, opts_hash="o")
    names = ["upload_id", "session_id", "arrival", "filename", "length", "is_pdf", "broken", "sha256", "opts_hash"]
    full = [{**base, "upload_id": i, "arrival": i, "sha256": f"h{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full],
                                 "upload_id bigint, session_id string, arrival bigint, filename string, length bigint, "
                                 "is_pdf boolean, broken boolean, sha256 string, opts_hash string")


def _pages(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, page_no int, text string")


def test_admit_reports_the_first_failing_check(spark, job_rows):
    ups = _uploads(spark, dict(length=C.MAX_BYTES + 1, is_pdf=False), dict(is_pdf=False, broken=True), dict(broken=True),
                   dict(), dict(), dict(), dict(), dict(sha256="known"))
    pages = _pages(spark, *[(4, i, "long enough text") for i in range(C.MAX_PAGES + 1)], (5, 0, " short "),
                   (6, 0, "long enough text"), (7, 0, "long enough text"))
    jobs = job_rows(dict(id="x", status="done", sha256="known", opts_hash="o", result_dir="r/k", n_tables=2, n_images=4))
    rows = {int(r.id): r for r in admission.admit(ups, pages, jobs, 5.0).collect()}
    messages = C.REJECT_MESSAGES
    assert [rows[i].error for i in range(8)] == [
        messages["too_big"], messages["not_pdf"], messages["broken"], messages["empty"], messages["too_many_pages"],
        messages["no_text"], None, None]
    assert [rows[i].status for i in range(8)] == ["failed"] * 6 + ["queued", "done"]
    assert [rows[i].sha256 for i in range(8)] == ["-", "-", "h2", "h3", "h4", "h5", "h6", "known"]
    assert [rows[i].page_total for i in range(8)] == [None] * 4 + [501, 1, 1, 1]
    assert (rows[7].result_dir, rows[7].n_tables, rows[7].n_images, rows[7].finished_at) == ("r/k", 2, 4, 5.0)
    assert rows[6].finished_at is None and rows[6].created_at == 5.0


def test_quota_counts_queued_and_earlier_uploads_of_the_batch(spark, job_rows):
    n = C.MAX_QUEUED_PER_SESSION
    ups = _uploads(spark, *[dict(is_pdf=i % 4 != 1, session_id="s2" if i % 4 == 3 else "s1") for i in range(60)])
    pages = _pages(spark, *[(i, 0, "long enough text") for i in range(60)])
    jobs = job_rows(*[dict(id=f"q{i}", session_id="s1") for i in range(5)], dict(id="d", status="done"))
    rows = {int(r.id): r.status for r in admission.admit(ups, pages, jobs, 5.0).collect()}
    taken = {"s1": 5, "s2": 0}
    for i in range(60):
        session = "s2" if i % 4 == 3 else "s1"
        expected = "failed" if i % 4 == 1 or taken[session] >= n else "queued"
        taken[session] += expected == "queued"
        assert rows[i] == expected, i


def test_identical_uploads_in_one_batch_are_both_queued(spark, job_rows):
    ups = _uploads(spark, dict(sha256="same"), dict(sha256="same"))
    pages = _pages(spark, (0, 0, "long enough text"), (1, 0, "long enough text"))
    assert [r.status for r in admission.admit(ups, pages, job_rows(dict(id="x")), 1.0).collect()] == ["queued"] * 2


def test_uploaded_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "c.pdf").write_bytes(b"PK\x03\x04zip")
    files = up.scan_uploads(spark, str(tmp_path), "*.pdf")
    marked = up.with_content_hash(up.with_magic(files))
    assert sorted(r.is_pdf for r in marked.collect()) == [False, True, True]
    assert sorted((r.length, r.n_copies) for r in up.unique_blobs(marked).collect()) == [(7, 1), (13, 2)]
    assert [r.too_big for r in up.flag_oversize(files, 10).orderBy("too_big").collect()].count(False) == 1
    plan = up.flag_oversize(files, 10).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)]" in plan and "content" not in plan.split("ReadSchema")[1]


def test_lines_and_back(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, "\n".join(str(i) for i in range(3000)))], "doc_id int, text string")
    lines = up.to_lines(docs)
    assert [(r.n, r.x) for r in lines.filter("doc_id = 1").orderBy("n").collect()] == [(0, "a"), (1, ""), (2, "b"), (3, "")]
    assert sorted(map(tuple, up.to_docs(lines.repartition(7, F.rand(1))).collect())) == sorted(map(tuple, docs.collect()))
