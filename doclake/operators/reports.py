"""Measurements over finished jobs and over document text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.functions.arrays import let
from doclake.functions.markdown import RULES, SYMBOL, clean_markdown
from doclake.operators.jobs import earlier_active


RUN_ON = "[가-힣]{13,}"


def calibrate(jobs: DataFrame) -> DataFrame:
    """Seconds per page of real conversions; cache hits have no start time and drop out."""
    ran = jobs.filter((F.col("status") == "done") & F.col("started_at").isNotNull()
                      & F.col("finished_at").isNotNull() & (F.col("page_total") > 0))
    seconds = F.sum(F.col("finished_at") - F.col("started_at"))
    return ran.agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("page_total").alias("pages"),
                   (seconds / F.nullif(F.sum("page_total"), F.lit(0))).alias("sec_per_page"))


def wait_estimate(jobs: DataFrame, sec_per_page: float = C.SEC_PER_PAGE) -> DataFrame:
    """Queued jobs with the pages of all active jobs before them and the seconds these will take."""
    pages = F.coalesce(F.nullif(F.col("page_total"), F.lit(0)), F.lit(1))
    return (earlier_active(jobs, pages, "pages_ahead")
            .withColumn("wait_sec", F.col("pages_ahead") * F.lit(sec_per_page)))


def _run_on_words(text: Column) -> Column:
    def count(t: Column) -> Column:
        words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w.rlike(RUN_ON))
        return F.when(t.rlike(RUN_ON), F.size(words)).otherwise(0)
    return let(text, count)


def runon_report(docs: DataFrame, col: str = "text") -> DataFrame:
    """Words with more than 12 Hangul syllables in a row, before and after the clean-up."""
    return (docs.select(_run_on_words(F.col(col)).alias("raw"), _run_on_words(clean_markdown(F.col(col))).alias("clean"))
            .agg(F.sum("raw").alias("n_before"), F.sum("clean").alias("n_after"),
                 F.count_if(F.col("raw") != F.col("clean")).alias("n_docs_changed")))


def symbol_report(docs: DataFrame, col: str = "text") -> DataFrame:
    """How often each list symbol occurs and in how many documents.

    Counts are taken per document first, so that a symbol leaves a document as one row.
    """
    found = F.regexp_extract_all(F.col(col), F.lit(SYMBOL), F.lit(0))
    per_doc = F.transform(F.array_distinct(found), lambda s: F.struct(
        s.alias("symbol"), (F.length(col) - F.length(F.replace(F.col(col), s, F.lit("")))).alias("n")))
    return (docs.select(F.explode(per_doc).alias("s"))
            .groupBy("s.symbol").agg(F.sum("s.n").alias("n"), F.count(F.lit(1)).alias("n_docs")))


def rule_changes(docs: DataFrame, col: str = "text") -> DataFrame:
    """How many documents each rule of the clean-up changes, in one pass; a row carries one text and a flag per rule."""
    def apply(state: Column, rule: Callable[[Column], Column]) -> Column:
        return let(state, lambda s: let(let(s["t"], rule), lambda new: F.struct(
            new.alias("t"), F.concat(s["flags"], F.array(new != s["t"])).alias("flags"))))

    state = F.struct(F.concat(F.col(col), F.lit("\n")).alias("t"), F.array().cast("array<boolean>").alias("flags"))
    for _, rule in RULES:
        state = apply(state, rule)
    flags = docs.select(state["flags"].alias("_f"))
    changed = flags.agg(*[F.count_if(F.col("_f")[i]).alias(name) for i, (name, _) in enumerate(RULES)])
    return changed.unpivot([], [name for name, _ in RULES], "rule", "n_docs_changed")
