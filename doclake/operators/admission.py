"""Ordered checks that decide what happens to an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators.cache import KEY, cached_results
from doclake.operators.jobs import queued_counts
from doclake.operators.skew import running_total
from doclake.sources.scratch import freeze
from doclake.sources.uploads import flag_oversize, is_pdf


def text_probe(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page count and characters on evenly spread sample pages of ``pages(key, page_no, text)``.

    Only lengths leave the scan. Sample pages are looked up by document and page, a key that no single
    document dominates.
    """
    sizes = pages.select(key, "page_no", F.length(F.trim("text", F.lit(C.WHITE_SPACE))).alias("chars"))
    counts = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / C.PROBE_PAGES)).cast("int")
    sampled = counts.select(key, "n_pages", F.explode(
        F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1, step)).alias("page_no"))
    return (sampled.join(sizes, [key, "page_no"], "left")
            .groupBy(key).agg(F.max("n_pages").alias("n_pages"),
                              F.coalesce(F.sum("chars"), F.lit(0)).alias("text_chars")))


def reject_reason(over_quota: Column) -> Column:
    """The first check that fails, or null."""
    return (F.when(F.col("length") > C.MAX_BYTES, "too_big")
            .when(~F.col("is_pdf"), "not_pdf")
            .when(over_quota, "over_quota")
            .when(F.col("broken"), "broken")
            .when(F.col("n_pages") == 0, "empty")
            .when(F.col("n_pages") > C.MAX_PAGES, "too_many_pages")
            .when(F.col("text_chars") < C.MIN_TEXT_CHARS, "no_text"))


def classify_uploads(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``; needs length, is_pdf, over_quota, broken, n_pages and text_chars."""
    return df.withColumn("reject_reason", reject_reason(F.col("over_quota")))


def with_probe(uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """Add page count and sample characters; files without pages get zeros."""
    probe = text_probe(pages.withColumnRenamed("doc_id", "upload_id"), "upload_id")
    return uploads.join(probe, "upload_id", "left").fillna(0, ["n_pages", "text_chars"])


def session_quota(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``over_quota``: the session has the allowed number of queued jobs when the upload arrives.

    ``eligible`` marks uploads that would be queued if there were no quota. Counting all of them is exact:
    beyond the cap the count stays beyond the cap.
    """
    # only keys and places are ordered; the rows themselves are joined back
    order = uploads.select("session_id", "arrival", "upload_id", F.col("eligible").cast("int").alias("_eligible"))
    earlier = running_total(order, ["session_id"], [F.col("arrival"), F.col("upload_id")], F.col("_eligible"), "_earlier")
    over = (earlier.join(queued_counts(jobs), "session_id", "left")
            .select("upload_id", (F.coalesce("n_queued", F.lit(0)) + F.col("_earlier") >= C.MAX_QUEUED_PER_SESSION).alias("over_quota")))
    return uploads.join(over, "upload_id")


def admit(uploads: DataFrame, pages: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """Job rows for a batch of uploads: queued, finished from the cache, or failed with a reason."""
    return admit_probed(with_probe(uploads, pages), jobs, now)


def admit_probed(uploads: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """``admit`` for uploads that have ``n_pages`` and ``text_chars``."""
    probed = uploads.join(cached_results(jobs), KEY, "left")
    eligible = reject_reason(F.lit(False)).isNull() & F.col("cached_id").isNull()
    # The quota reads its input several times; storing it once spares the probe and the cache join.
    judged = session_quota(freeze(probed.withColumn("eligible", eligible), "admission"), jobs)
    reason = F.col("reject_reason")
    messages = F.create_map(*[F.lit(x) for kv in C.REJECT_MESSAGES.items() for x in kv])
    hit = reason.isNull() & F.col("cached_id").isNotNull()
    return classify_uploads(judged).select(
        F.col("upload_id").cast("string").alias("id"), "session_id", "filename",
        F.when(reason.isin("too_big", "not_pdf", "over_quota"), "-").otherwise(F.col("sha256")).alias("sha256"),
        "opts_hash",
        F.when(reason.isNotNull(), "failed").when(hit, "done").otherwise("queued").alias("status"),
        F.when(reason.isNull() | reason.isin("too_many_pages", "no_text"),
               F.col("n_pages").cast("int")).alias("page_total"),
        F.lit(None).cast("double").alias("started_at"),
        F.when(reason.isNotNull() | hit, F.lit(now)).alias("finished_at"),
        F.when(reason.isNotNull(), F.element_at(messages, reason)).alias("error"),
        F.when(hit, F.col("result_dir")).alias("result_dir"),
        F.when(hit, F.col("n_tables")).alias("n_tables"),
        F.when(hit, F.col("n_images")).alias("n_images"),
        F.lit(0).alias("attempts"), F.lit(now).alias("created_at"))


def from_files(files: DataFrame, options: DataFrame, pages: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Uploads with their probe from files (``path, modificationTime, length, content``), for ``admit_probed``.

    A file stands in a folder ``session=<id>/opts=<hash>``, further folders may follow; a file whose option hash is
    not among ``options`` is left out. ``pages`` (``sha256, page_no, text``) is what an extractor read from the
    content, ``broken`` (``sha256``) what it could not open. The body of a file that is too large is never read, and
    no bytes are shuffled; pages are looked up for the hashes that arrived.
    """
    place = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)
    rows = flag_oversize(files).select(
        F.col("path").alias("upload_id"), place("session").alias("session_id"), place("opts").alias("opts_hash"),
        F.col("modificationTime").alias("arrival"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length",
        is_pdf(F.col("content")).alias("is_pdf"), F.sha2("content", 256).alias("sha256"))
    rows = freeze(rows, "arrived").join(options.select("opts_hash"), "opts_hash", "left_semi")
    hashes = rows.filter("is_pdf").select("sha256").distinct()
    probe = text_probe(pages.join(hashes, "sha256", "left_semi"), "sha256")
    rows = rows.join(probe, "sha256", "left").fillna(0, ["n_pages", "text_chars"])
    if broken is None:
        return rows.withColumn("broken", F.lit(False))
    return (rows.join(broken.select("sha256", F.lit(True).alias("broken")).distinct(), "sha256", "left")
            .fillna(False, ["broken"]))
