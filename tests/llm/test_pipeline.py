import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from doclake.llm import pieces
from llm.brute import quality_counts, similarity_classes


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's stored result, on documents with extra and null rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.limit(1).withColumns({"doc_id": F.lit(90_000).cast("long"), "text": F.lit(None).cast("string")})
    docs = docs.union(extra)
    out, folder = [docs], tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(results):
    for df in results[1:-1]:
        assert df.columns == results[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scans", "sentencepiece"]


def test_quality_stage_drops_what_fails(results):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in results[:2])
    assert set(after) < set(before) and 90_000 not in after
    assert not any(quality_counts(t)["base_failed"] for t in after.values())
    assert all(after[d] == before[d] for d in after)


def test_join_stage_keeps_one_of_each_class(results):
    before = [(r["doc_id"], r["text"]) for r in results[1].collect()]
    assert sorted(r["doc_id"] for r in results[2].collect()) == sorted({c for _, c in similarity_classes(before).values()})


def test_decontamination_stage_drops_leaks_only(spark, results):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in results[2:4])
    for d, t in before.items():
        if any(i in t for i in items):
            assert d not in after
    assert len(after) >= 0.9 * len(before)


def test_secret_stage_masks_and_keeps_all(results):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in results[3:5])
    assert set(before) == set(after)
    assert not any(re.search("AKIA[0-9A-Z]{16}", t) for t in after.values())


def test_last_stage_encodes_what_is_left(results):
    texts = {r["doc_id"]: r["text"] for r in results[4].collect()}
    model = pieces.Pieces(pieces.model_path())
    rows = results[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(model.decode(__import__("numpy").array(r["ids"])) == texts[r["doc_id"]] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_run_applies_all_stages_and_empty_tables_pass(spark, results):
    assert corpus_pipeline.run(spark, SMALL).count() == results[-1].count()
    docs = results[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
