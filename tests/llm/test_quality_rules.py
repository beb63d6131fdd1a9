import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.brute import quality_counts
from conftest import SMALL
from doclake.llm import quality_rules as Q
from doclake.llm.queries import QUERIES

LONG = " ".join(f"w{i}" for i in range(40_000))
CASES = [None, "", "  \n\t ", "one", "a b c d e a b c d e", "x " * 30, "a b c d e f " * 3 + "tail of it all",
         "line one\nline one\n\nline one\nother", "## *bold* $5 100% a|b <tag>", LONG, LONG + " " + LONG[:300],
         "a b c d", "é è 日本 😀 word\x0bnext\x0cpage"]


def test_counts_match_brute_force(spark, documents):
    rows = Q.measured(documents(*CASES)).select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words", "base_failed").collect()
    assert len(rows) == len(CASES)
    for r in rows:
        want = quality_counts(r["text"])
        assert {k: r[k] for k in want} == want, r["text"] and r["text"][:50]


def test_query_matches_brute_force(spark):
    got = QUERIES["op1_quality_rules"](spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = quality_counts(docs[r["doc_id"]]["text"])
        assert {k: r[k] for k in want} == want


def test_thresholds_are_the_quartile_fences_of_each_group(spark):
    """Small groups are exact in a sketch, so the limits equal those of plain quantiles."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stats = Q.measured(docs)
    limits = Q.thresholds(stats, min_rows=1).collect()
    values = stats.filter(~F.col("base_failed")).toPandas()
    for r in limits:
        own = values[(values.lang == r["lang"]) & (values.source == r["source"])]
        if len(own) > Q.SKETCH_K:
            continue
        for f in Q.FENCES:
            low, high = np.quantile(own[f.measure], [0.25, 0.75], method="inverted_cdf")
            assert r[f"{f.measure}_high"] == pytest.approx(high + f.slack * (high - low) + f.gap, rel=0.2, abs=0.05)


def test_small_groups_take_the_limits_of_language_and_corpus(spark, documents):
    docs = documents(*["plain words of one usual text " + " ".join(f"{c}{i}" for i in range(20)) for c in "abcdef"])
    docs = docs.withColumn("source", F.concat(F.lit("s"), "doc_id"))
    own = Q.thresholds(Q.measured(docs), min_rows=5).collect()
    assert len(own) == 6 and len({r["word_length_high"] for r in own}) == 1
    assert len({r["word_length_high"] for r in Q.thresholds(Q.measured(docs), min_rows=99).collect()}) == 1


def test_symbol_junk_goes_and_plain_text_stays(spark, documents):
    plain = ["some plain words in a short text " + " ".join(f"{c}word{i}" for i in range(30)) for c in "abcdefghij"]
    junk = " ".join(f"word{i}***" for i in range(40))
    out = {r["_row"]["doc_id"]: r for r in Q.judged(documents(*plain, junk), min_rows=1).collect()}
    assert all(out[i]["kept"] for i in range(10))
    assert not out[10]["kept"] and out[10]["reasons"] == "symbol_share" and not out[10]["base_failed"]


def test_labels_agree(spark):
    """Documents labelled good stay unless the base rule fails them; bad ones go."""
    base = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality_rules"](spark, base)
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad)


def test_nulls_repeats_clashes_and_empty(spark, documents):
    docs = documents(None, "", "a b c d e f g h i j k", "a b c d e f g h i j k")
    docs = docs.withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"),
                             "n_words": F.lit("mine"), "kept": F.lit(1), "_row": F.lit(2)})
    out = Q.judged(docs, min_rows=1).collect()
    assert len(out) == 4 and [r["kept"] for r in out].count(True) == 2
    kept = Q.keep_good(docs, min_rows=1)
    assert kept.columns == docs.columns and kept.count() == 2 and kept.first()["n_words"] == "mine"
    assert Q.judged(docs.limit(0)).count() == 0
    assert Q.keep_good(docs.limit(0)).columns == docs.columns


def test_main_path_is_native(spark):
    plan = QUERIES["op1_quality_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
