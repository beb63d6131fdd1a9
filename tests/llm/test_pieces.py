import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import pieces as P
from doclake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


@pytest.fixture(scope="module")
def model():
    return P.Pieces(P.model_path())


def test_ids_equal_those_of_the_library(library, model):
    rng = random.Random(2)
    bits = [" ", "  ", "     ", "\n", "a", "the", "é", "日本", "😀", "▁", ".", ",", "ing", "tion", "Th", " " * 20, "\t", "2024", "ﬁ",
            "xxxxx", " " * 70, "Σ", "<s>", "<0x0A>", "\x00", "aaaa", "zzz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += ["", " ", "   ", " " * 200, "x" * 5000, "supercalifragilistic " * 50]
    for text, ids in zip(texts, model.encode(texts)):
        ids = np.frombuffer(ids, np.int32)
        assert ids.tolist() == library.encode(text), text[:50]
        assert model.decode(ids) == text.replace("▁", " ")


def test_prefix_states_are_shared_in_sorted_order(model):
    words = sorted({"▁the", "▁then", "▁thence", "▁there", "▁a", "plain", "▁thenceforth"})
    assert {w: p for w, p in model.segment_all(words)} == {w: model.merged(w) for w in words}


def test_query_matches_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_sentencepiece"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = library.encode(docs[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert r["same_text"] and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())


def test_nulls_long_texts_repeats_clashes_and_empty(spark, documents, library):
    long = "Wörter and words " * 20_000
    docs = documents(None, "", "a b", "a b", long).union(documents("x")).withColumns({"ids": F.lit("mine"), "_text": F.lit(0)})
    rows = P.encoded(docs)
    got = [(r["doc_id"], r["ids"]) for r in rows.collect()]
    want = [(0, []), (1, []), (2, library.encode("a b")), (3, library.encode("a b")), (4, library.encode(long)), (0, library.encode("x"))]
    assert sorted(got) == sorted(want)
    back = sorted((r["doc_id"], r["text"]) for r in P.decoded(rows).collect())
    assert back == sorted([(0, ""), (1, ""), (2, "a b"), (3, "a b"), (4, long), (0, "x")])
    assert P.encoded(docs.limit(0)).count() == 0
    null_ids = rows.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))
    assert [r["text"] for r in P.decoded(null_ids).collect()] == [""]


def test_the_next_task_of_a_worker_knows_the_words_of_the_last(documents, monkeypatch):
    docs = documents("tasks share words", "words share tasks").select("doc_id", "text")
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: tasks.append(run) or df)
    P.encoded(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "_text": ["tasks share words", "words share tasks"]})
    list(tasks[0](iter([batch])))
    assert {"▁tasks", "▁share", "▁words"} <= set(P.load(P.model_path()).words)
