import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import language_model as L
from doclake.llm.queries import QUERIES


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def base_scores(docs):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in docs]
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for d, ws in tokens]


def _agree(rows, want):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_query_matches_brute_force_and_predicts_held_out_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = QUERIES["op5_language_model"](spark, SMALL).collect()
    _agree(rows, base_scores(docs))
    size = {d: len(L.symbols(pa.array([t]))[0]) for d, t in docs}
    out = [r for r in rows if r["held_out"]]
    per_symbol = sum(r["score"] for r in out) / sum(size[r["doc_id"]] for r in out)
    counts = np.bincount(np.concatenate([L.symbols(pa.array([t]))[0] for d, t in docs if not held(d)]), minlength=256) + 1
    flat = sum(np.log10(counts / counts.sum())[L.symbols(pa.array([t]))[0]].sum() for d, t in docs if held(d))
    assert per_symbol > 0.85 * flat / sum(size[r["doc_id"]] for r in out)


def test_tree_gives_a_distribution_and_the_longest_suffix(spark, documents):
    """The next-symbol probabilities sum to 1 in every state; scores equal a walk over the text with a dictionary."""
    tree = L.grow(documents(*["the cat and the hat sat on the mat " * 3] * 9, "another text about other things").select("doc_id", "text"))
    p = 10.0 ** tree.log_p
    other = 256 - (tree.log_p.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + other * p[:, -1], 1, atol=1e-4)
    assert len(p) > 10
    texts = ["the cat", "", None, "zebra the ü", "the hat " * 5000]
    want = []
    for t in texts:
        s = L.symbols(pa.array([t], pa.string()))[0].tolist()
        total = 0.0
        for i, x in enumerate(s):
            state = 0
            for k in range(1, L.DEPTH + 1):
                older = s[i - k] if i >= k else L.END
                nxt = tree.child[state, tree.column[older]]
                if not nxt:
                    break
                state = nxt
            total += float(tree.log_p[state, tree.column[x]])
        want.append(total)
    assert tree.scores(pa.array(texts, pa.string())) == pytest.approx(want, rel=1e-4)


def test_long_columns_score_as_single_texts(monkeypatch):
    rng = np.random.default_rng(2)
    child = rng.integers(0, 6, (6, 256)).astype(np.int32)
    prob = rng.random((6, 256))
    tree = L.SuffixTree(child, prob / prob.sum(axis=1, keepdims=True), np.arange(256))
    text = "".join(rng.choice(list("abc de"), 1_200_000))
    both = tree.scores(pa.array(["x y", text, "a"]))
    assert both[1] == pytest.approx(tree.scores(pa.array([text]))[0]) and both[0] == pytest.approx(tree.scores(pa.array(["x y"]))[0])


def test_nulls_repeats_clashes_and_empty(spark, documents):
    docs = documents(None, "", "a A b", "a a a", "unseen words", "a\x00b", "x").union(documents("a b"))
    docs = docs.union(documents("null id").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({"block": F.lit("b"), "score": F.lit(0)})
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = L.scored(docs).collect()
    _agree(rows, base_scores(pairs))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert L.scored(docs.limit(0)).count() == 0
    only = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    _agree(L.scored(only).collect(), base_scores([(r["doc_id"], r["text"]) for r in only.collect()]))
