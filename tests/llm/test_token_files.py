import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from doclake.llm import token_files as T
from doclake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.tokenizer_path())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def expected(library, docs):
    """(doc_id, start, n_tokens, crc) in ascending order of the id."""
    start, out = 0, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = _ids(library, t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_encode_as_the_library_does(library):
    rng = random.Random(2)
    bits = [" ", "  ", "     ", "\n", " \n", "a", "the", "é", "日本", "😀", "'s", ".", ",", "ing", "Th", "\t", "2024", "ﬁ", " " * 70,
            "<|endoftext|>", " ", "　", "!!", "***", "\r\n", "don't", "Ġ", " x", " word", " x.", " y,\n", "\x85", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(2000)] + [None, "", " ", "x" * 5000]
    spaces = ["\xa0", " \xa0", "\xa0 ", " ", "\u2009", "\u3000", "\x85", "\x1c", "\n", "\n ", " \n", "\t", "a", "b", "9", ".", "'s", "é "]
    texts += ["".join(rng.choice(spaces) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    texts += ["a \xa0 \xa0 b", "a\xa0 b", "one.\nTwo three\n", "\nx", "x\n\ny", "x\n\xa0y z"]
    model = T.WordEncoder(T.tokenizer_path())
    for text, raw in zip(texts, model.encode(texts)):
        assert np.frombuffer(raw, model.dtype).tolist() + [2] == _ids(library, text), text


def test_query_reads_back_what_the_library_encodes(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [tuple(r) for r in QUERIES["op10_token_files"](spark, SMALL).collect()]
    assert sorted(rows) == expected(library, docs)


def test_files_hold_flat_ids_and_offsets(spark, documents, library, tmp_path):
    folder = f"file://{tmp_path}/out"
    texts = ["one two", None, "", "three " * 30_000, "four", "five"]
    manifest = T.write_shards(documents(*texts), folder, shards=3).orderBy("shard").collect()
    assert [m["base"] for m in manifest] == [sum(m["n_tokens"] for m in manifest[:i]) for i in range(len(manifest))]
    flat = np.concatenate([np.memmap(f"{tmp_path}/out/{m['name']}.bin", "<u2", "r") for m in manifest])
    assert flat.tolist() == [i for t in texts for i in _ids(library, t)]
    for m in manifest:
        index = np.memmap(f"{tmp_path}/out/{m['name']}.idx", "<i8", "r")
        n = index[0]
        assert n == m["n_docs"] and len(index) == 3 * n + 2 and index[-1] == m["n_tokens"]


def test_null_and_repeated_ids_clashes_and_empty(spark, documents, library, tmp_path):
    docs = documents("b", "a", "c").union(documents("z").withColumn("doc_id", F.lit(None).cast("long"))).union(documents("x y"))
    docs = docs.withColumns({"shard": F.lit("s"), "start": F.lit(1)})
    folder = f"file://{tmp_path}/out"
    rows = T.read_documents(T.write_shards(docs, folder, shards=4), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 0, 1, 2]
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(5)]
    crc = {zlib.crc32(np.array(_ids(library, t), "<u4").tobytes()) for t in ("b", "x y")}
    assert {r["ids_crc32"] for r in rows[1:3]} == crc
    empty = f"file://{tmp_path}/none"
    assert T.read_documents(T.write_shards(docs.limit(0), empty), empty).count() == 0


def test_the_next_task_of_a_worker_knows_the_words_of_the_last(documents, monkeypatch, tmp_path):
    docs = documents("tasks share words", "words share tasks")
    tasks = []

    def caught(df, run, schema):
        tasks.append(run)
        raise InterruptedError
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    with pytest.raises(InterruptedError):
        T.write_shards(docs, f"file://{tmp_path}", shards=1)
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text": ["tasks share words", "words share tasks"],
                                        "shard": pa.array([0, 0], pa.int32())})
    list(tasks[0](iter([batch])))
    model, learnt = T.load(T.tokenizer_path()), []
    monkeypatch.setattr(model, "_learn", lambda start, words: learnt.extend(words))
    list(tasks[0](iter([batch])))
    assert learnt == []


def test_a_word_of_a_slice_is_looked_up_once_in_the_table_of_the_worker():
    class Table(dict):
        asked = 0

        def __getitem__(self, word):
            Table.asked += 1
            return super().__getitem__(word)
    model = T.WordEncoder(T.tokenizer_path())
    texts = ["here again and again and again", "again and here"] * 20
    first = model.encode(texts)
    model.words = Table(model.words)
    assert model.encode(texts) == first == [model._packed(t) for t in texts]
    assert Table.asked <= 4         # "", again, and, here
