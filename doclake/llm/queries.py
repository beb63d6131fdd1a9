"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import byte_pairs, decontamination, hard_negatives, jaccard_join, language_model, licenses, merkle, pieces, quality_classifier, quality_rules, secrets, token_files, url_filters
from doclake.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # Only the id is carried along: the result holds no text.
    rows = quality_rules.judged(docs, carry=["doc_id"])
    return rows.select("_row.doc_id", F.expr("* EXCEPT (_row)"))


@query
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.similarity_classes(_table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark, sf_dir):
    rows = pieces.encoded(_table(spark, sf_dir, "documents"), carry=["doc_id", "text"])
    return pieces.digests(rows)


@query
def op3_license_scans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scanned(docs, carry=["doc_id"]).select("_row.doc_id", F.expr("* EXCEPT (_row)"))


@query
def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op5_language_model(spark, sf_dir):
    return language_model.scored(_table(spark, sf_dir, "documents"))


@query
def op6_secret_scans(spark, sf_dir):
    # the documents have no path; their source stands for it
    rows = secrets.scanned(_table(spark, sf_dir, "documents"), path="source")
    return rows.select("doc_id", "word_no", "value", F.round("score", 6).alias("score"), "secret")


@query
def op7_url_filters(spark, sf_dir):
    return url_filters.judged(_table(spark, sf_dir, "pages"))


@query
def op8_decontamination(spark, sf_dir):
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_token_files(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_shards(_table(spark, sf_dir, "documents"), folder)
    return token_files.read_documents(manifest, folder)


@query
def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.embeddings_mined(_table(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.checked(merkle.documents_manifest(_table(spark, sf_dir, "documents")))


@query
def op13_byte_pairs(spark, sf_dir):
    return byte_pairs.digests(byte_pairs.encoded(_table(spark, sf_dir, "documents")))
