"""The derived view of pages that admission probes."""

import time

from pyspark.sql import functions as F

from doclake.operators.admission import text_probe
from doclake.plans import derived as D


def test_pages_of_a_long_text_cost_no_more_than_those_of_short_ones(spark, tmp_path):
    """Each page used to be counted off from the start of its text again."""
    took = {}
    for name, n_docs in (("warm", 2), ("short", 4000), ("long", 1)):
        text = "".join(f"wörter{i % 10} 😀" for i in range(400_000 // n_docs))
        spark.range(1, n_docs + 1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit(len(text)).cast("long").alias("n_chars")
                                          ).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        begun = time.time()
        rows = D.page_text(spark, f"file://{tmp_path}/{name}").filter("doc_id > 0")
        n = rows.agg(F.sum(F.length("text"))).first()[0]
        took[name] = time.time() - begun
        assert n == n_docs * len(text)
    got = [r.text for r in rows.orderBy("page_no").collect()]
    assert got == [text[k:k + 200] for k in range(0, len(text), 200)]
    assert took["long"] < 3 * took["short"] + 1


def test_pages_where_the_stored_length_is_wrong_or_missing(spark, tmp_path):
    rows = [(1, "ab" * 150, 300), (2, "ab" * 150, 250), (3, "ab" * 150, 500), (4, "x", 0), (5, None, 300), (6, "x", None), (13, "x\ny", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(tuple, D.page_text(spark, f"file://{tmp_path}").collect()), key=str)
    whole, rest = "ab" * 100, "ab" * 50
    assert got == sorted([(1, 0, whole), (1, 1, rest), (2, 0, whole), (2, 1, rest), (3, 0, whole), (3, 1, rest), (3, 2, ""),
                          (4, 0, "x"), (4, -1, "x"), (5, 0, None), (5, 1, None), (13, 0, "x\ny"), (-14, 0, " ")], key=str)


def test_the_probe_strips_all_white_space(spark):
    pages = spark.createDataFrame([(1, 0, "\x1c　 a b \x85"), (1, 1, "​\x1f"), (2, 0, None)], "doc_id long, page_no int, text string")
    assert {tuple(r) for r in text_probe(pages).collect()} == {(1, 2, 4), (2, 1, 0)}
