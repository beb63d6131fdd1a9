import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import decontamination as D
from doclake.llm.queries import QUERIES
from doclake.llm.texts import hashed_words
from llm.brute import alnum_words, subsequence


def test_query_finds_every_item_that_stands_in_a_text(spark):
    """Brute force: all items against all windows of all texts, by plain dynamic programming on rare-word hits."""
    items = {r["item_id"]: alnum_words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: alnum_words(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = set()
    for d, words in docs.items():
        have = set(words)
        for i, item in items.items():
            if len(set(item) & have) < 0.6 * len(set(item)):
                continue
            m = len(item)
            if max(subsequence(item, words[s:s + m + m // 4]) for s in range(0, max(1, len(words) - m + 1), m // 8 or 1)) >= 0.8 * m:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, SMALL).collect()}
    assert want and len(want & got) >= 0.9 * len(want)
    assert got <= want


def _corpus(rng, n, words=200):
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in range(400)]
    common = ["the", "of", "and", "in", "to", "a"]
    pick = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary)
    return [" ".join(pick() for _ in range(words)) for _ in range(n)]


def test_paraphrases_are_found_and_clean_texts_left_alone(spark, documents):
    rng = random.Random(3)
    texts, items = _corpus(rng, 300), _corpus(rng, 60, 35)
    planted = {}
    for k, item in enumerate(items):
        words = item.split()
        if k % 3 == 1:      # reworded: a fifth of the words exchanged
            for p in rng.sample(range(len(words)), 7):
                words[p] = f"other{k}x{p}"
        if k % 3 == 2:      # words put in and left out
            words = [w for p, w in enumerate(words) if p % 7]
            words.insert(5, "inserted")
        body = texts[k].split()
        at = rng.randrange(len(body))
        texts[k] = " ".join(body[:at] + words + body[at:])
        planted[k] = k
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(documents(*texts), benchmark).collect()}
    assert len(got & set(planted.items())) >= 0.9 * len(planted)
    assert got <= set(planted.items())


def test_cosine_search_recalls_what_brute_force_cosine_finds(spark, documents):
    """With small blocks the space has fewer dimensions than items; candidates are measured against full vectors."""
    rng = random.Random(4)
    texts, items = _corpus(rng, 100), _corpus(rng, 200, 35)
    for k in range(50):
        texts[k] += " " + items[k]
    docs = documents(*texts)
    _, idf = D.document_weights(docs)
    block = D.read_items([{"item_id": i, "text": t} for i, t in enumerate(items)], idf)
    windows = D.Windows(block, idf)
    space = D.latent_space(block, windows, docs)
    assert space.shape[1] <= D.RANK < len(block)
    h, rows = hashed_words(pa.array(texts), alnum=True)
    number = windows.numbers(h)
    _, start, end = windows.bounds(rows)
    length, _ = windows.lengths(h, number, start, end)
    ends = np.cumsum([len(x.words) for x in block])
    first = np.concatenate(([0], ends[:-1]))
    own = np.concatenate([x.words for x in block])
    size, _ = windows.lengths(own, windows.numbers(own), first, ends)

    def cosines(base):
        return (windows.folded(number, start, end, base) @ windows.folded(windows.numbers(own), first, ends, base).T
                / np.sqrt(np.outer(length, size)))
    exact = cosines(np.eye(len(windows.vocabulary), dtype=np.float32)) >= 0.5
    assert exact.sum() >= 50 and (cosines(space) >= D.MIN_COSINE)[exact].mean() >= 0.9


def test_nulls_short_items_long_texts_and_clashes(spark, documents):
    long = " ".join(f"word{i}" for i in range(60_000))
    item = " ".join(f"rare{i}" for i in range(30))
    docs = documents(None, "", "nothing to see here", long + " " + item + " " + long, "find the short one here", item)
    docs = docs.union(docs.filter("doc_id = 5")).withColumns({"item_id": F.lit("mine"), "cosine": F.lit(1)})
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (5, item.upper())],
                                      "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs, benchmark).collect())
    assert got == [(3, 1), (3, 5), (4, 4), (5, 1), (5, 1), (5, 5), (5, 5)]
    kept = D.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]
    assert D.leaks(docs.limit(0), benchmark).count() == 0
    assert D.leaks(docs, benchmark.limit(0)).count() == 0
    assert D.keep_clean(docs, benchmark.limit(0)).count() == docs.count()


def test_edited_copies_of_a_passage_that_a_third_of_the_rows_carry_are_found(spark, documents):
    """All words of the item are common then; one edited word, or a third of them reworded, is a leak all the same."""
    rng = random.Random(5)
    texts, item = _corpus(rng, 300), " ".join(f"hot{i}" for i in range(30))
    edited, reworded = set(range(0, 300, 6)), set(range(3, 300, 6))
    for k in edited | reworded:
        words = item.split()
        for p in [rng.randrange(30)] if k in edited else rng.sample(range(12, 30), 10):   # the answer stays
            words[p] = f"other{k}x{p}"
        texts[k] += " " + " ".join(words)
    benchmark = spark.createDataFrame([(1, item, "hot0 hot1 hot2 hot3 hot4 hot5 hot6 hot7 hot8 hot9 hot10 hot11")],
                                      "item_id long, text string, answer string")
    docs = documents(*texts)
    got = {r["doc_id"] for r in D.leaks(docs, benchmark).collect()}
    assert got == edited | reworded
    assert {r["doc_id"] for r in D.keep_clean(docs, benchmark).collect()} == set(range(300)) - got


def test_long_items_are_found_verbatim_and_reworded(spark, documents):
    """Items of 100 to 900 words, as they are and with every other word exchanged outside the answer."""
    rng = random.Random(6)
    texts, sizes = _corpus(rng, 100, 1200), [100, 200, 400, 500, 700, 900] * 5
    items = [_corpus(rng, 1, m)[0] for m in sizes]
    want = set()
    for k, item in enumerate(items):
        words = item.split()
        if k % 2:
            for p in range(40, len(words), 2):
                words[p] = f"other{k}x{p}"
        body = texts[k].split()
        at = rng.randrange(len(body))
        texts[k] = " ".join(body[:at] + words + body[at:])
        want.add((k, k))
    benchmark = spark.createDataFrame([(k, x, " ".join(x.split()[:40])) for k, x in enumerate(items)],
                                      "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(documents(*texts), benchmark).collect()}
    assert got == want


def test_the_space_counts_every_window_of_every_document(spark, documents):
    """A'A of 6,000 documents against counting each window; no document is left out."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(25)] + ["out"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 70])))
             for _ in range(6_000)]
    docs = documents(*texts, None)
    size, idf = D.document_weights(docs)
    items = D.read_items([{"item_id": 1, "text": " ".join(vocabulary[:-1])}], idf)
    windows = D.Windows(items, idf)
    h, rows = hashed_words(pa.array(texts), alnum=True)
    number = windows.numbers(h)
    _, start, end = windows.bounds(rows)
    counts = np.stack([np.bincount(number[a:b][number[a:b] >= 0], minlength=25) for a, b in zip(start, end)])
    n, shared = D.shared_windows(docs, windows)
    assert size == 6_001 and n == len(start) and (shared == counts.T @ counts).all()
    seen = []
    original = D.latent_space
    try:
        D.latent_space = lambda block, windows, rows: seen.append(rows.count()) or original(block, windows, rows)
        D.Detector(docs, spark.createDataFrame([(1, " ".join(vocabulary))], "item_id long, text string"))
    finally:
        D.latent_space = original
    assert seen == [6_001]


def test_windows_that_cannot_reach_a_passage_are_not_folded(spark, documents, monkeypatch):
    """Most windows hold words of some passage, few hold enough of one; the others cost no folding, and no leak is lost."""
    rng = random.Random(9)
    texts, items = _corpus(rng, 200, 400), _corpus(rng, 40, 40)
    for k in range(0, 40, 4):
        texts[k] += " " + items[k]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    detector = D.Detector(documents(*texts), benchmark)
    folded, plain = [], D.Windows.folded

    def counted(self, number, start, end, base):
        folded.append(len(start))
        return plain(self, number, start, end, base)
    monkeypatch.setattr(D.Windows, "folded", counted)
    column = pa.array(texts)
    got = sorted(detector.find(column))
    few = sum(folded)
    assert {r[:2] for r in got} >= {(k, k) for k in range(0, 40, 4)}
    monkeypatch.setattr(D.Windows, "summed", lambda self, number, start, end, value: np.full(len(start), np.inf))
    folded.clear()
    everything = sorted(detector.find(column))
    assert [r[:4] for r in got] == [r[:4] for r in everything]
    assert 3 * few < sum(folded), (few, sum(folded))
