"""Quality rules with thresholds that follow the corpus.

Each document is measured once. The measures of a language and source are summed up in mergeable quantile
sketches (KLL), the sketches of small groups are merged upwards, and the fences read from them are joined back
to the measured documents. Nothing but DataFrame functions runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.arrays import let
from doclake.llm.texts import packed, words
from doclake.sources.scratch import freeze

WINDOW = 5          # words of a window that counts as repeated
MIN_WORDS = 10
SKETCH_K = 200      # accuracy of a sketch: about 1.3 % of rank


@dataclass(frozen=True)
class Fence:
    """Limits of one measure: quartile -/+ (``slack`` x quartile distance + ``gap``).

    ``gap`` is the resolution of the measure: where most documents have the same value, the quartile
    distance is 0, and smaller differences are noise.
    """
    measure: str
    slack: float
    gap: float
    two_sided: bool = False


FENCES = (
    Fence("symbol_share", 3.0, 0.03),
    Fence("dup_line_share", 3.0, 0.4),
    Fence("repeat_share", 3.0, 0.15),
    Fence("word_length", 4.0, 3.0, two_sided=True),
)


def _repeat_words(w: Column) -> Column:
    """Number of words inside windows that occur at least twice in ``w``.

    Windows are compared by a 64-bit hash. Only documents with a repeated window sort them by position.
    """
    # xxhash64 chains its arguments: five words in a row give the hash of the window.
    def hashes(w):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
                           lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p):
            same = F.filter(p, lambda x, i: (F.get(p, i + 1)["h"] == x["h"])
                            | ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(s):
            steps = F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
        return let(pairs, lambda p: let(starts(p), total))

    # bound to a variable first: an optimizer may put the expression of ``w`` where its column stands
    return let(w, lambda v: let(hashes(v), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)))


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the document), lang, source, the counts and the measures of each document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counts = (packed(docs, ["text", "lang", "source"], carry)
              .withColumns({"_words": words(F.col("text")), "_lines": lines})
              .select("_row", "lang", "source",
                      F.size("_words").cast("long").alias("n_words"),
                      F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                      (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long")
                      .alias("n_symbols"),
                      F.size("_lines").alias("_n_lines"),
                      (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                      _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words")))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return counts.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "_n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    }).drop("_n_lines")


def thresholds(stats: DataFrame, fences=FENCES, min_rows: int = 200) -> DataFrame:
    """``lang, source``, and ``<measure>_low, <measure>_high`` per fence.

    A group with fewer than ``min_rows`` documents takes the fences of its language, a small language those
    of the whole corpus, all from merged sketches. Nulls in ``lang`` and ``source`` are groups of their own.
    Documents that fail the base rule do not shape the thresholds.
    """
    names = [f.measure for f in fences]
    sketches = freeze(stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in names]), "sketches")
    merged = [F.kll_merge_agg_double(m).alias(m) for m in names]
    by_lang = sketches.groupBy("lang").agg(F.sum("n").alias("n"), *merged)

    def limits(df: DataFrame) -> DataFrame:
        out = {}
        for f in fences:
            low, high = (F.kll_sketch_get_quantile_double(f.measure, F.lit(q)) for q in (0.25, 0.75))
            reach = f.slack * (high - low) + f.gap
            out[f"{f.measure}_low"] = low - reach if f.two_sided else F.lit(float("-inf"))
            out[f"{f.measure}_high"] = high + reach
        return df.withColumn("_limits", F.struct(*[v.alias(k) for k, v in out.items()])).drop(*names)

    total = limits(by_lang.agg(F.sum("n").alias("n"), *merged).filter("n > 0")).first()      # one row at most
    if total is None:
        whole = F.lit(None)
    else:
        whole = F.struct(*[F.lit(v).alias(k) for k, v in total["_limits"].asDict().items()])
    lang = limits(by_lang).select(F.col("lang").alias("_lang"), F.col("n").alias("_n"),
                                  F.col("_limits").alias("_lang_limits"))
    chosen = (limits(sketches).join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
              .withColumn("_limits", F.when(F.col("n") >= min_rows, F.col("_limits"))
                          .when(F.col("_n") >= min_rows, F.col("_lang_limits")).otherwise(whole)))
    return freeze(chosen.select("lang", "source", "_limits.*"), "thresholds")


def judged(docs: DataFrame, fences=FENCES, min_rows: int = 200, carry: list[str] | None = None) -> DataFrame:
    """``_row``, the counts, ``base_failed``, ``reasons`` (failed rules) and ``kept`` for every row of ``docs``.

    ``docs`` has ``text, lang, source`` and any other columns. Null and empty texts have no words and fail the
    base rule. Repeated rows are judged each, ties with a threshold pass. Documents of a group in which all
    fail the base rule have no threshold and fail anyway. Texts of any length count whole. An empty table gives
    an empty result.
    """
    stats = freeze(measured(docs, carry), "measured")
    limits = thresholds(stats, fences, min_rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang"))
                      & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = [F.when(F.col("base_failed"), "base")]
    failed += [F.when(~F.col(f.measure).between(F.col(f"{f.measure}_low"), F.col(f"{f.measure}_high")), f.measure)
               for f in fences]
    return (rows.withColumn("reasons", F.array_join(F.array(*failed), ","))
            .withColumn("kept", F.col("reasons") == "")
            .select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "reasons", "kept"))


def keep_good(docs: DataFrame, fences=FENCES, min_rows: int = 200) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judged(docs, fences, min_rows).filter("kept").select("_row.*")
