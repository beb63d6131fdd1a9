"""One query per operator over the given tables; ``plans.oracle`` holds the SQL to check them against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators import admission, cache, convert, extract, feed, jobs, long_markdown, markdown, queue_index, reports
from doclake.plans import derived as D
from doclake.sources import keyed, results, snapshots, uploads
from doclake.sources.scratch import scratch_path
from doclake.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Text of a job's file name with the cases that a folder name has to survive.
AWKWARD_NAME = """CASE page_total % 5 WHEN 0 THEN concat('a/b:', filename, '*') WHEN 1 THEN '..'
  WHEN 2 THEN concat(' ', filename, '.pdf') ELSE filename END"""
# Revision 6 made a third of the results.
OLD_HASH = "'rev=6;img=1;csv=1'"
# Of the files that the scan reads, some are larger.
SCAN_LIMIT = 50_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks -------------------------------------------------------

@query
def scan_uploads(spark, sf):
    path = scratch_path(spark, "uploads")
    parts = D.table(spark, sf, "documents").select((F.col("doc_id") % 64).alias("part"), "text")
    parts.repartition("part").write.option("lineSep", "\n").partitionBy("part").text(path)
    files = uploads.flag_oversize(uploads.scan_uploads(spark, path, "*.txt", columns=["part"]), SCAN_LIMIT)
    return files.select(F.col("part").cast("bigint"), "length", "too_big",
                        F.octet_length("content").cast("bigint").alias("n_read"))


def _blobs(spark, sf):
    head = F.when(F.col("doc_id") % 17 != 0, "%PDF-1.7\n").otherwise("PK\x03\x04")
    return D.table(spark, sf, "documents").select("doc_id", F.encode(F.concat(head, "text"), "utf-8").alias("content"))


@query
def magic_test(spark, sf):
    return uploads.with_magic(_blobs(spark, sf)).select("doc_id", "is_pdf")


@query
def content_hash(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.encode("text", "utf-8").alias("content"))
    hashed = uploads.with_content_hash(docs).withColumn("length", F.octet_length("content"))
    return uploads.unique_blobs(hashed.select("sha256", "length"))


@query
def document_lines(spark, sf):
    return uploads.to_lines(D.table(spark, sf, "documents"))


@query
def document_roundtrip(spark, sf):
    return uploads.to_docs(uploads.to_lines(D.table(spark, sf, "documents")))


@query
def result_sink(spark, sf):
    rows = D.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("sha256"), cache.opts_hash(F.col("doc_id") % 2, F.lit(1)).alias("opts_hash"),
        "text", (F.col("n_chars") % 7).cast("int").alias("n_tables"), (F.col("n_chars") % 5).cast("int").alias("n_images"))
    path = scratch_path(spark, "results")
    results.write_results(rows, path)
    return spark.read.parquet(path)


@query
def table_csv_sink(spark, sf):
    path = scratch_path(spark, "tables")
    results.write_table_csv(D.raw_docs(spark, sf), path)
    return results.read_table_csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query
def packed_csv(spark, sf):
    path = scratch_path(spark, "packed")
    results.write_packed_csv(D.raw_docs(spark, sf), path, pack_bytes=1 << 20)
    return results.read_packed_csv(spark, path)


@query
def upsert_results(spark, sf):
    path = scratch_path(spark, "keyed")
    rows = D.jobs(spark, sf).filter("status = 'done'").select(
        "sha256", "opts_hash", "id", "finished_at", "n_tables", "n_images")
    # the second lot brings new keys, newer results of old ones, and rows that have been written before
    for lot in (F.col("n_images") < 3, F.col("n_images") > 1):
        results.upsert_results(rows.filter(lot), path, ["finished_at", "id"])
    return keyed.read(spark, path).drop("bucket")


def _result_files(job_rows):
    present = job_rows.filter("status = 'done' AND result_dir NOT LIKE 'r/0%'").select("result_dir").distinct()
    names = F.array(*[F.lit(n) for n in ("doc.md", "images/image-1.png", "tables/table-01.csv")])
    return present.select("result_dir", F.explode(names).alias("rel_path"))


@query
def bundle_manifest(spark, sf):
    job_rows = D.jobs(spark, sf).withColumn("filename", F.expr(AWKWARD_NAME))
    return results.bundle_manifest(job_rows, _result_files(job_rows), admin=True)


@query
def safe_names(spark, sf):
    job_rows = D.jobs(spark, sf).withColumn("filename", F.expr(AWKWARD_NAME))
    return results.safe_names(job_rows, [-F.col("created_at"), F.col("id")]).select("id", "folder")


# --- admission ---------------------------------------------------------------

@query
def text_probe(spark, sf):
    return admission.text_probe(D.page_text(spark, sf))


@query
def classify_uploads(spark, sf):
    probed = admission.with_probe(D.uploads(spark, sf), D.page_text(spark, sf))
    return (admission.classify_uploads(probed.withColumn("over_quota", F.col("upload_id") % 23 == 0))
            .select("upload_id", "reject_reason"))


@query
def session_quota(spark, sf):
    rows = D.uploads(spark, sf).withColumn("eligible", F.col("is_pdf") & (F.col("length") <= C.MAX_BYTES))
    return admission.session_quota(rows, D.jobs(spark, sf)).select("upload_id", "over_quota")


@query
def admit(spark, sf):
    return admission.admit(D.uploads(spark, sf), D.page_text(spark, sf), D.jobs(spark, sf), D.NOW_LIVE)


# --- cache -------------------------------------------------------------------

@query
def opts_hash(spark, sf):
    docs = D.table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 2 == 0).alias("include_images"), (F.col("doc_id") % 3 == 0).alias("include_csv"))
    return cache.with_opts_hash(docs).select("doc_id", "opts_hash")


def _mixed_revisions(spark, sf):
    old = F.substring(F.sha2(F.expr(OLD_HASH), 256), 1, 16)
    return D.jobs(spark, sf).withColumn("opts_hash", F.when(F.col("page_total") % 3 == 0, old).otherwise(F.col("opts_hash")))


@query
def decode_opts(spark, sf):
    return cache.decode_opts(_mixed_revisions(spark, sf)).select("id", "include_images", "include_csv", "stale")


@query
def fail_stale(spark, sf):
    return cache.fail_stale(_mixed_revisions(spark, sf), D.NOW_LIVE).select("id", "status", "error", "finished_at")


@query
def cached_results(spark, sf):
    return cache.cached_results(D.jobs(spark, sf))


@query
def apply_cache(spark, sf):
    hits = cache.apply_cache(D.uploads(spark, sf), cache.cached_results(D.jobs(spark, sf)))
    return hits.select("upload_id", "status", "result_dir", "n_tables", "n_images")


@query
def invalidated(spark, sf):
    return cache.invalidated(_mixed_revisions(spark, sf), C.CONVERTER_REV).select("id", "result_dir")


# --- job log -----------------------------------------------------------------

JOB_COLUMNS = ["id", "session_id", "filename", "sha256", "opts_hash", "status", "page_total", "started_at",
               "finished_at", "error", "result_dir", "n_tables", "n_images", "attempts", "created_at"]


@query
def fold_jobs(spark, sf):
    return jobs.fold_jobs(D.job_events(spark, sf)).select(*JOB_COLUMNS)


@query
def list_jobs(spark, sf):
    return jobs.list_jobs(D.jobs(spark, sf), session="s7", limit=C.LIST_LIMIT).select("id", "status", "created_at")


@query
def list_jobs_admin(spark, sf):
    return jobs.list_jobs(D.jobs(spark, sf), admin=True, limit=C.LIST_LIMIT).select("id", "session_id", "created_at")


@query
def session_view(spark, sf):
    shown = jobs.session_view(D.jobs(spark, sf), D.NOW_LIVE, session="s7", limit=C.LIST_LIMIT)
    return shown.select("id", "status", "progress", "ahead", "busy")


@query
def json_rows(spark, sf):
    shown = jobs.serialize(D.jobs(spark, sf), D.NOW_LIVE)
    return feed.to_json_rows(shown.select("id", "status", "progress", "ahead"))


@query
def owned(spark, sf):
    requests = D.jobs(spark, sf).select(
        F.concat(F.lit("q"), "id").alias("request_id"), "id",
        F.expr("CASE WHEN page_total % 2 = 0 THEN session_id ELSE 's1' END").alias("session_id"),
        (F.col("page_total") % 7 == 0).alias("admin"))
    return jobs.owned(D.jobs(spark, sf), requests)


@query
def queued_counts(spark, sf):
    return jobs.queued_counts(D.jobs(spark, sf))


@query
def with_ahead(spark, sf):
    return jobs.with_ahead(D.jobs(spark, sf)).select("id", "ahead")


@query
def is_busy(spark, sf):
    return jobs.is_busy(D.jobs(spark, sf))


@query
def with_progress(spark, sf):
    return jobs.with_progress(D.jobs(spark, sf), D.NOW_LIVE).select("id", "progress")


@query
def serialize(spark, sf):
    return jobs.serialize(D.jobs(spark, sf), D.NOW_LIVE)


@query
def next_in_line(spark, sf):
    return jobs.next_in_line(D.jobs(spark, sf), 10).select("id", "created_at")


@query
def requeue_running(spark, sf):
    return jobs.requeue_running(D.jobs(spark, sf)).select("id", "status", "started_at", "attempts")


@query
def quarantine(spark, sf):
    return jobs.quarantine(D.jobs(spark, sf), D.NOW_LIVE).select("id", "status", "error", "finished_at")


@query
def retain(spark, sf):
    return jobs.retain(D.jobs(spark, sf), D.NOW_SWEEP).select("id", "created_at")


@query
def expired(spark, sf):
    return jobs.expired(D.jobs(spark, sf), D.NOW_SWEEP).select("id", "created_at")


@query
def orphan_files(spark, sf):
    job_rows = D.jobs(spark, sf)
    files = (job_rows.select(F.lit("upload").alias("kind"), F.col("sha256").alias("name"))
             .unionByName(job_rows.filter("result_dir IS NOT NULL").select(
                 F.lit("result").alias("kind"), F.substring_index("result_dir", "/", -1).alias("name"))).distinct())
    return jobs.orphan_files(files, job_rows, D.NOW_SWEEP)


@query
def with_label(spark, sf):
    return jobs.with_label(jobs.serialize(D.jobs(spark, sf), D.NOW_LIVE)).select("id", "label")


@query
def session_summary(spark, sf):
    return jobs.session_summary(D.jobs(spark, sf))


@query
def indexed_view(spark, sf):
    path = scratch_path(spark, "queue")
    rows = D.jobs(spark, sf)
    queue_index.build_queue_index(rows, path)
    shown = queue_index.indexed_view(rows, path, D.NOW_LIVE, session="s7")
    return shown.select("id", "status", "progress", "ahead", "pages_ahead", "wait_sec")


@query
def bucketed_fold(spark, sf):
    table = f"events_{uuid.uuid4().hex}"
    return jobs.fold_jobs(snapshots.write_bucketed(D.job_events(spark, sf), table)).select(*JOB_COLUMNS)


@query
def changes_by_digest(spark, sf):
    old, new = scratch_path(spark, "old"), scratch_path(spark, "new")
    snapshots.write_snapshot(D.jobs(spark, sf), old, folders=64)
    # the newer one lacks some rows and has some others
    current = D.curr_jobs(spark, sf)
    added = current.filter("page_total = 7").withColumn("id", F.concat(F.lit("new-"), F.col("id")))
    snapshots.write_snapshot(current.filter("page_total <> 5").unionByName(added), new, folders=64)
    return feed.apply_full(*snapshots.read_changed(spark, old, new)).filter("change <> 'same'")


# --- change feed -------------------------------------------------------------

def _ticks(spark, sf):
    return jobs.with_ahead(D.jobs(spark, sf)), jobs.with_ahead(D.curr_jobs(spark, sf))


@query
def diff_snapshots(spark, sf):
    return feed.diff_snapshots(*_ticks(spark, sf)).select("id", "status", "finished_at", "ahead")


@query
def feed_frame(spark, sf):
    prev, curr = _ticks(spark, sf)
    return feed.feed_frame(feed.diff_snapshots(prev, curr), jobs.is_busy(D.curr_jobs(spark, sf)), True)


def _delta(spark, sf):
    """Running rows of the later snapshot, and the finished ones under new ids."""
    curr = D.curr_jobs(spark, sf)
    return (curr.filter(F.col("finished_at") == D.NOW_LIVE)
            .unionByName(curr.filter("status = 'failed'").withColumn("id", F.concat(F.lit("new-"), "id"))))


@query
def apply_delta(spark, sf):
    return feed.apply_delta(D.jobs(spark, sf), _delta(spark, sf)).select("id", "status", "finished_at")


@query
def apply_full(spark, sf):
    snapshot = D.curr_jobs(spark, sf).filter("status <> 'failed'").unionByName(
        _delta(spark, sf).filter("id LIKE 'new-%'"))
    return feed.apply_full(D.jobs(spark, sf), snapshot)


@query
def settled(spark, sf):
    return feed.settled(D.jobs(spark, sf), D.curr_jobs(spark, sf))


@query
def changed_fields(spark, sf):
    prev = jobs.with_label(jobs.serialize(D.jobs(spark, sf), D.NOW_LIVE))
    curr = jobs.with_label(jobs.serialize(D.curr_jobs(spark, sf), D.NOW_LIVE))
    return feed.changed_fields(prev, curr).select("id", F.array_join("fields", ",").alias("fields"))


# --- Markdown ----------------------------------------------------------------

@query
def unescape(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", "html")
    return pages.transform(markdown.unescape, "html")


def _rule(name: str) -> None:
    def run(spark, sf):
        return D.raw_docs(spark, sf).transform(getattr(markdown, name))
    run.__name__ = name
    query(run)


MARKDOWN_RULES = ("strip_private_glyphs", "fix_bullets", "merge_headings", "join_wrapped", "normalize_depths",
                  "despace", "tighten", "leftover_symbols", "collapse_spaces", "relevel_headings")
for _name in MARKDOWN_RULES:
    _rule(_name)
_rule("clean_markdown")


@query
def clean_long_markdown(spark, sf):
    lines = uploads.to_lines(D.raw_docs(spark, sf))
    return long_markdown.clean_docs(lines, lines_per_block=64)


# --- extraction --------------------------------------------------------------

@query
def extract_tables(spark, sf):
    return extract.extract_tables(D.raw_docs(spark, sf))


@query
def count_artifacts(spark, sf):
    return extract.count_artifacts(D.raw_docs(spark, sf))


@query
def apply_image_mode(spark, sf):
    return extract.apply_image_mode(D.raw_docs(spark, sf), F.col("doc_id") % 2 == 0)


def _raw_by_hash(spark, sf):
    """One raw text per content: that of its first document; some contents could not be read."""
    first = D.table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"))
    return D.raw_docs(spark, sf).join(first.filter("doc_id % 41 <> 0"), "doc_id").select("sha256", "text")


@query
def convert_jobs(spark, sf):
    rows, raw = _mixed_revisions(spark, sf), _raw_by_hash(spark, sf)
    asked = convert.to_convert(rows)
    made = convert.convert(asked, raw)
    csv = convert.tables(asked, raw).groupBy("sha256", "opts_hash").agg(F.count(F.lit(1)).alias("n_csv"))
    texts = made.select("sha256", "opts_hash", "text").join(csv, ["sha256", "opts_hash"], "left")
    after = convert.settle(rows, made, D.NOW_LIVE)
    return (after.join(texts, ["sha256", "opts_hash"], "left")
            .select("id", "status", "error", "finished_at", "result_dir", "n_tables", "n_images", "n_csv", "text"))


# --- reports -----------------------------------------------------------------

@query
def calibrate(spark, sf):
    return reports.calibrate(D.jobs(spark, sf))


@query
def wait_estimate(spark, sf):
    return reports.wait_estimate(D.jobs(spark, sf)).select("id", "pages_ahead", "wait_sec")


@query
def runon_report(spark, sf):
    return reports.runon_report(D.raw_docs(spark, sf))


@query
def symbol_report(spark, sf):
    return reports.symbol_report(D.raw_docs(spark, sf))


@query
def rule_changes(spark, sf):
    return reports.rule_changes(D.raw_docs(spark, sf))


# --- streaming ---------------------------------------------------------------

def _arriving(spark, parts):
    """A stream source that is filled part by part: yields the stream once for each part that has arrived."""
    path = scratch_path(spark, "arriving")
    for part in parts:
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(part.schema).parquet(path)


def _in_order(df, column, n=3):
    """``df`` in ``n`` parts by ranges of a whole-number column."""
    top = df.agg(F.max(column)).first()[0] or 0
    return [df.filter(F.floor(F.col(column) * n / (top + 1)) == i) for i in range(n)]


@query
def stream_admit(spark, sf):
    out, progress = scratch_path(spark, "admitted"), scratch_path(spark, "progress")
    for stream in _arriving(spark, _in_order(D.uploads(spark, sf), "arrival")):
        feeds.stream_admit(stream, D.page_text(spark, sf), D.jobs(spark, sf), out, progress, D.NOW_LIVE).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _stored(spark, parts, mode, over):
    """Run the stream that ``over`` makes of each part as it arrives, and read back what was written."""
    out, progress = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    for stream in _arriving(spark, parts):
        feeds.stream_to_batches(over(stream), out, progress, mode).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_dedup(spark, sf):
    rows = D.jobs(spark, sf).select("sha256", "opts_hash", F.timestamp_seconds("created_at").alias("created"),
                                    F.expr("CAST(substring(id, 2) AS bigint)").alias("n"))
    stored = _stored(spark, _in_order(rows, "n"), "append", lambda s: feeds.stream_dedup(s.drop("n")))
    return stored.select("sha256", "opts_hash")


def _uses_in_lots(spark, sf):
    uses = D.uses(spark, sf).withColumn("created", F.timestamp_seconds("created_at"))
    return [uses.filter(F.col("arrival") == n) for n in range(TICKS)]


@query
def stream_entries(spark, sf):
    rows = _stored(spark, _uses_in_lots(spark, sf), "append", lambda s: feeds.stream_entries(s, lateness="48 hours"))
    seconds = lambda c: F.unix_timestamp(c).cast("double").alias(f"{c}_at")
    return rows.select("sha256", "opts_hash", "first_id", "n_uses", seconds("started"), seconds("expires"))


@query
def stream_retain(spark, sf):
    return _stored(spark, _uses_in_lots(spark, sf), "append", feeds.stream_retain).select("id")


@query
def stream_fold(spark, sf):
    folded = _stored(spark, _log_in_ticks(spark, sf), "update", feeds.stream_fold)
    return feeds.latest(folded, ["id"]).select(*JOB_COLUMNS)


# The tick in which an event of the log arrives: jobs in two lots, then claims, then ends.
TICK = "CASE seq WHEN 1 THEN {n} % 2 WHEN 2 THEN 1 + CAST({n} % 3 = 0 AS int) ELSE 2 + CAST({n} % 5 = 0 AS int) END"
TICKS = 4


def _log_in_ticks(spark, sf):
    events = D.job_events(spark, sf).withColumn("_tick", F.expr(TICK.format(n="CAST(substring(id, 2) AS bigint)")))
    return [events.filter(F.col("_tick") == n).drop("_tick") for n in range(TICKS)]


@query
def stream_feed(spark, sf):
    out, state, progress = (scratch_path(spark, name) for name in ("frames", "feed", "progress"))
    for stream in _arriving(spark, _log_in_ticks(spark, sf)):
        feeds.stream_feed(stream, out, state, progress, clock=lambda: D.NOW_LIVE).awaitTermination()
    return spark.read.parquet(out).select(F.col("batch").alias("tick"), "id", "status", "finished_at", "ahead")




@query
def stream_expired(spark, sf):
    n = F.expr("CAST(substring(id, 2) AS bigint)")
    uses = D.uses(spark, sf).select("id", F.col("created_at").alias("_base"), "arrival")
    events = (D.job_events(spark, sf).join(uses, "id")
              .withColumn("at", F.timestamp_seconds(F.col("_base") + F.col("seq") * 600)).drop("_base"))
    lots = [events.filter(F.col("arrival") == k).drop("arrival") for k in range(TICKS)]
    rows = _stored(spark, lots, "append", lambda s: feeds.stream_expired(s, lateness="48 hours"))
    return rows.select(*JOB_COLUMNS, F.unix_timestamp("expires").cast("double").alias("expires_at"))
