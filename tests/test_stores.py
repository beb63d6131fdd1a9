"""Keyed results, packed CSV files, conversion by the options of a job."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators import cache, convert
from doclake.operators.extract import csv_tables
from doclake.sources import keyed, results, uploads

TABLE = "| a | b |\n| --- | --- |\n| 1 | x, y |\n| \"q\" | 2 |\n"


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/part-*")}


def test_upsert_keeps_one_row_per_key_and_untouched_files(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "sha256 string, opts_hash string, text string, finished_at double"
    first = spark.createDataFrame([(f"h{i}", "o", "old", 1.0) for i in range(200)], schema)
    put = lambda df: results.upsert_results(df, path, ["finished_at"], buckets=16)
    put(first)
    before = _files(path)
    new = spark.createDataFrame([("h7", "o", "new", 2.0), ("h7", "o", "newest", 3.0), ("h8", "o", "older", 0.5), ("fresh", "o", "new", 1.0)], schema)
    put(new)
    put(new)
    rows = {r.sha256: (r.text, r.finished_at) for r in keyed.read(spark, path).collect()}
    assert len(rows) == keyed.read(spark, path).count() == 201
    assert rows["h7"] == ("newest", 3.0) and rows["h8"] == ("old", 1.0) and rows["fresh"] == ("new", 1.0)
    touched = {r[0] for r in new.select(keyed.bucket_of(["sha256", "opts_hash"], 16)).collect()}
    same = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and same.items() <= _files(path).items()
    put(first.limit(0))
    assert keyed.read(spark, path).count() == 201 and keyed.read(spark, str(tmp_path / "none")) is None


def test_packed_tables_are_byte_equal_in_few_files(spark, tmp_path):
    path = str(tmp_path / "packed")
    big = "| " + "x" * 5_000 + " |\n| - |\n"
    docs = spark.createDataFrame([(i, TABLE * (i % 3) if i % 2 else "é\n\n" + TABLE.replace("x", "한글") + "\n" + TABLE) for i in range(60)]
                                 + [(99, big), (100, "none")], "doc_id long, text string").repartition(5)
    results.write_packed_csv(docs, path, pack_bytes=1_000)
    want = {(r.doc_id, r.table_no): results.BYTE_ORDER_MARK + r.csv for r in csv_tables(docs).collect()}
    got = {(r.doc_id, r.table_no): r.csv for r in results.read_packed_csv(spark, path).collect()}
    assert got == want
    packs = glob.glob(f"{path}/packs/pack=*/part-*")
    assert len(packs) == len(glob.glob(f"{path}/packs/pack=*")) < len(want) / 4
    assert sum(map(os.path.getsize, packs)) == sum(len(v.encode()) + 1 for v in want.values())
    one = results.read_packed_csv(spark, path, (F.col("doc_id") == 99) & (F.col("table_no") == 1)).collect()
    assert [(r.doc_id, r.csv) for r in one] == [(99, want[99, 1])]
    results.write_packed_csv(docs.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty/index")).count() == 0


@pytest.fixture
def hashes(spark):
    return {(r.include_images, r.include_csv): r.opts_hash for r in cache.options(spark).collect()}


def test_options_decide_images_and_tables(spark, job_rows, hashes):
    raw = spark.createDataFrame([("doc", f"- ㅇ R&amp;D\n![i](/tmp/images/a.png)\n{TABLE}"), ("plain", "text")], "sha256 string, text string")
    jobs = job_rows(
        dict(id="both", sha256="doc", opts_hash=hashes[True, True]), dict(id="none", sha256="doc", opts_hash=hashes[False, False]),
        dict(id="again", sha256="doc", opts_hash=hashes[True, True]), dict(id="plain", sha256="plain", opts_hash=hashes[True, True]),
        dict(id="gone", sha256="lost", opts_hash=hashes[True, True]), dict(id="stale", sha256="doc", opts_hash="other"),
        dict(id="poison", sha256="only", opts_hash=hashes[True, True], attempts=1),
        dict(id="old", sha256="doc", opts_hash=hashes[True, False], status="done", n_tables=9, result_dir="r"))
    asked = convert.to_convert(jobs)
    assert sorted((r.sha256, r.include_images, r.include_csv) for r in asked.collect()) == [
        ("doc", False, False), ("doc", True, True), ("lost", True, True), ("plain", True, True)]
    made = convert.convert(asked, raw)
    rows = {(r.sha256, r.opts_hash): r for r in made.collect()}
    both, none = rows["doc", hashes[True, True]], rows["doc", hashes[False, False]]
    assert both.text.startswith("- R&D\n![i](images/a.png)\n") and none.text.startswith(f"- R&D\n{C.IMAGE_PLACEHOLDER}\n")
    assert (both.n_tables, both.n_images) == (none.n_tables, none.n_images) == (1, 1) and len(rows) == 3
    csv = convert.tables(asked, raw).collect()
    assert [(r.sha256, r.opts_hash, r.table_no, r.csv) for r in csv] == [("doc", hashes[True, True], 1, 'a,b\n1,"x, y"\n"""q""",2')]
    after = {r.id: (r.status, r.error, r.n_tables, r.result_dir) for r in convert.settle(jobs, made, 5.0).collect()}
    assert after["both"] == after["again"] == ("done", None, 1, f"doc-{hashes[True, True]}")
    assert after["plain"] == ("done", None, 0, f"plain-{hashes[True, True]}") and after["old"] == ("done", None, 9, "r")
    assert after["gone"][:2] == ("failed", convert.NO_TEXT) and after["stale"][:2] == ("failed", C.STALE_OPTIONS_MESSAGE)
    assert after["poison"][:2] == ("failed", C.POISON_MESSAGE)


def test_table_files_are_made_by_many_tasks_and_listed_by_few(spark, tmp_path):
    docs = spark.createDataFrame([(i, TABLE + "\n" + TABLE.replace("x", str(i)) if i % 5 == 0 else TABLE) for i in range(200)] + [(None, TABLE)],
                                 "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "tables")
    results.write_table_csv(docs, path)
    files = glob.glob(f"{path}/doc_id=*/table=table-*/part-*.txt")
    assert len(files) == len({os.path.dirname(f) for f in files}) == 241
    assert len({os.path.basename(f).split("-")[1] for f in files}) > 8
    before = spark.conf.get(uploads.LISTING_TASKS)
    spark.sparkContext.setJobGroup("listing", "")
    rows = uploads.scan_uploads(spark, path, columns=["doc_id", "table"])
    spark.sparkContext.setJobGroup("rest", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= uploads.many_tasks(spark) < 201
    assert spark.conf.get(uploads.LISTING_TASKS) == before
    got = {(r.doc_id, int(r.table[-2:])): bytes(r.content).decode() for r in rows.collect()}
    assert got == {(r.doc_id, r.table_no): results.BYTE_ORDER_MARK + r.csv + "\n" for r in csv_tables(docs).collect()}


def test_small_files_share_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, TABLE.replace("x", str(i))) for i in range(150)], "doc_id long, text string")
    path = str(tmp_path / "tables")
    results.write_table_csv(docs, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")      # what opening one file counts for
    try:
        rows = results.read_table_csv(spark, path)
        assert uploads.scan_uploads(spark, path).rdd.getNumPartitions() == 150
        assert rows.rdd.getNumPartitions() <= uploads.many_tasks(spark) < 150
        got = {(r.doc_id, r.table): r.csv for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(r.doc_id, "table-01"): results.BYTE_ORDER_MARK + r.csv + "\n" for r in csv_tables(docs).collect()}
    assert got == want and len(want) == 150
