import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import byte_pairs as B
from doclake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return B.load(B.vocabulary_path())


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("library", pat_str=B.word_pattern(), mergeable_ranks=model.ranks, special_tokens={})


@pytest.fixture(scope="module")
def ids(model):
    words = B.Words(B.word_pattern(), {k: B.late_characters(k) for k in "LN"})
    return lambda text: np.frombuffer(model.encode(words.cut(text)), np.int32).tolist()


def test_texts_encode_as_the_library_does(ids, library):
    rng = random.Random(3)
    bits = [" ", "  ", "\xa0", " ", "　", "\n", "\t", " \n", "\r\n", "\x1c", "\x85", "'s", "'re", "a", "the", "ing", "é", "日本",
            "한국어", "😀", "1", "²", "٣", "!", "...", "-", "\U00010ee7", "ࢠ", "࢏", "\U0003246a", "x" * 60, "aaaaaaa", "\x00", "n't",
            "привет", "<|endoftext|>", *map(chr, range(0x80, 0x3000, 97))]
    for _ in range(10_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert ids(text) == library.encode_ordinary(text), text
    for _ in range(500):
        letters = rng.choice(["ab", "aab", "eitsn", "аеио", "日本語", "the "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 600)))
        assert ids(text) == library.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 20_000, " " * 30_000 + "x", "é" * 9_999, "=-" * 5_000, "word " * 150_000])
def test_long_texts(ids, library, text):
    assert ids(text) == library.encode_ordinary(text)


def plain_merges(ranks, word):
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_tree_equals_plain_merges_for_any_ranks(model):
    """Also for ranks that no training would give, where a merge may open one of a lower rank."""
    rng = random.Random(4)
    for _ in range(60):
        pieces = {bytes([c]) for c in b"abc"}
        while len(pieces) < 25:
            pieces.add(rng.choice(sorted(pieces)) + rng.choice(sorted(pieces)))
        order = rng.sample(sorted(pieces), len(pieces))
        model_ = B.BytePairs.__new__(B.BytePairs)
        model_.ranks = {p: i for i, p in enumerate(order)}
        model_.raw = {i: p for p, i in model_.ranks.items()}
        model_.forget()
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
            want = plain_merges(model_.ranks, word)
            assert model_.reduced(word) == want
            assert model_._merged_short(word) == want and model_._merged_long(word) == want
            cut = rng.randint(0, len(word))
            if 0 < cut < len(word):
                assert model_.join(plain_merges(model_.ranks, word[:cut]), plain_merges(model_.ranks, word[cut:])) == want


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def expected(library, rows):
    out = []
    for d, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((text or "").encode())))
    return sorted(out, key=str)


def test_query_against_the_library(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_byte_pairs"](spark, SMALL).collect()), key=str) == expected(library, rows)


def test_null_empty_repeated_and_clashing(spark, documents, library):
    texts = [None, "", "same", "same", " ", "a\n \xa0 b", "long " * 60_000]
    docs = documents(*texts).union(documents("x").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({"ids": F.lit("i"), "_text": F.lit("t"), "bytes": F.lit(1)})
    rows = [*enumerate(texts), (None, "x")]
    coded = B.encoded(docs)
    assert sorted((tuple(r) for r in B.digests(coded).collect()), key=str) == expected(library, rows)
    back = {(r["doc_id"], bytes(r["bytes"])) for r in B.decoded(coded).collect()}
    assert back == {(d, (t or "").encode()) for d, t in rows}
    assert B.digests(B.encoded(docs.limit(0))).count() == 0


def test_a_task_forgets_what_it_learnt(model):
    model.encode([["some", " words"]])
    model.forget()
    assert not model.words and not model.halves and not model.pairs
