"""From raw Markdown to results: what a job's options decide, and what becomes of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.functions.arrays import let
from doclake.functions.entities import unescape
from doclake.functions.markdown import clean_markdown
from doclake.operators.cache import KEY, decode_opts, fail_stale
from doclake.operators.extract import count_artifacts, csv_tables, image_mode
from doclake.operators.jobs import quarantine

NO_TEXT = "no converted text"


def to_convert(jobs: DataFrame) -> DataFrame:
    """Each content and option hash that queued jobs ask for, once, with the options; not for jobs in quarantine."""
    fresh = F.coalesce("attempts", F.lit(0)) < C.MAX_ATTEMPTS
    asked = jobs.filter((F.col("status") == "queued") & fresh).select(*KEY).distinct()
    return decode_opts(asked).filter(~F.col("stale")).drop("stale")


def final_text(raw: Column, include_images: Column) -> Column:
    """Images as references or placeholders, then character references, then the clean-up."""
    return let(let(image_mode(raw, include_images), unescape), clean_markdown)


def convert(asked: DataFrame, raw: DataFrame) -> DataFrame:
    """Results ``sha256, opts_hash, text, n_tables, n_images`` of ``asked``, from ``raw`` (``sha256, text``).

    Tables and images are counted in the raw text, whatever the options are. A content without raw text has no row.
    """
    work = asked.join(raw.select("sha256", "text"), "sha256")
    counted = work.join(count_artifacts(raw.join(asked.select("sha256"), "sha256", "left_semi"), "sha256"), "sha256")
    return counted.select(*KEY, final_text(F.col("text"), F.col("include_images")).alias("text"), "n_tables", "n_images")


def tables(asked: DataFrame, raw: DataFrame) -> DataFrame:
    """CSV tables ``sha256, opts_hash, table_no, csv`` of the keys whose options ask for them."""
    wanted = asked.filter("include_csv").select(*KEY)
    found = csv_tables(raw.join(wanted.select("sha256"), "sha256", "left_semi"), "sha256")
    return wanted.join(found, "sha256").select(*KEY, "table_no", "csv")


def settle(jobs: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """The job table after a run over all queued jobs.

    Jobs that already cost a worker and jobs whose options cannot be recovered fail first; of the others, those
    with a result are done, those without one fail. Only counts are joined, no text.
    """
    jobs = fail_stale(quarantine(jobs, now), now)
    made = results.select(*KEY, F.col("n_tables").alias("_tables"), F.col("n_images").alias("_images"), F.lit(True).alias("_made"))
    queued = F.col("status") == "queued"
    done = queued & F.col("_made").isNotNull()
    rows = jobs.join(made, KEY, "left")
    return rows.select(*[{
        "status": F.when(done, "done").when(queued, "failed").otherwise(F.col("status")).alias("status"),
        "error": F.when(queued & ~done, NO_TEXT).otherwise(F.col("error")).alias("error"),
        "finished_at": F.when(queued, F.lit(now)).otherwise(F.col("finished_at")).alias("finished_at"),
        "result_dir": F.when(done, F.concat_ws("-", *KEY)).otherwise(F.col("result_dir")).alias("result_dir"),
        "n_tables": F.when(done, F.col("_tables")).otherwise(F.col("n_tables")).alias("n_tables"),
        "n_images": F.when(done, F.col("_images")).otherwise(F.col("n_images")).alias("n_images"),
    }.get(c, F.col(c)) for c in jobs.columns])
