import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import quality_classifier as Q
from doclake.llm.queries import QUERIES


def test_density_difference_matches_plain_formulas():
    rng = np.random.default_rng(1)
    cov = [np.cov(rng.normal(size=(3, 50))) + np.eye(3) for _ in range(2)]
    mean = [rng.normal(size=3) for _ in range(2)]
    model = Q.Discriminant(mean, [np.linalg.cholesky(c) for c in cov], [np.linalg.slogdet(c)[1] for c in cov],
                           [np.log(0.3), np.log(0.7)])
    x = rng.normal(size=(20, 3))
    log = [p - 0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1])
           for m, c, p in zip(mean, cov, model.log_prior)]
    assert np.allclose(model.difference(x), log[1] - log[0])


def test_held_out_documents_are_told_apart(spark):
    base = "/root/testdata/sf0.01"
    rows = QUERIES["op4_quality_classifier"](spark, base)
    assert rows.count() == spark.read.parquet(f"{base}/documents.parquet").count()
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")
    got = [r for r in rows.join(labels, "doc_id").collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) for r in rows.collect())
    good = np.array([r["score"] for r in got if r["quality"] == 1])
    bad = np.array([r["score"] for r in got if r["quality"] == 0])
    assert (good[:, None] > bad).mean() >= 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    want = {r["doc_id"]: round(r["score"], 6) for r in Q.scored(docs, labels).collect()}
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "score": F.lit(3)})
    assert {r["doc_id"]: round(r["score"], 6) for r in Q.scored(changed, other).collect()} == want


def test_nulls_long_texts_repeats_and_too_few_labels(spark, documents):
    texts = [None, "", "   ", "some text " * 100_000, "a", "a"]
    assert np.isfinite(Q.statistics(pa.array(texts, pa.string()))).all()
    docs = documents(*texts).union(documents("z").withColumn("doc_id", F.lit(None).cast("long")))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.scored(docs, none).collect()
    assert len(rows) == 7 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    odd = spark.createDataFrame([(0, None, 0), (1, 5, 0), (2, 1, None), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.scored(docs, odd).count() == 7
    assert Q.scored(docs.limit(0), none).count() == 0
