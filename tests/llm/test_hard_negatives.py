import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import hard_negatives as H
from doclake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """All pairs: (vec_id, vector, label) rows."""
    part = []
    for d, v, label in rows:
        if d is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((d, (label + 1) % 10 if d % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for d, label, v in part:
        if d % 100 == 0:
            anchors[d] = min(anchors.get(d, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), d, other) for d, other, w in part if d != a)
        for s, d, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, m) for n, m, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, d, k, m, -s, -n) for k, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = result(QUERIES["op11_hard_negatives"](spark, SMALL))
    assert got and got == expected(rows)


def test_lengths_ties_hot_label_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_ROWS", 60)
    rng = random.Random(6)
    rows = []
    for i in range(700):
        size = rng.choice([4, 4, 4, 4, 3])
        scale = rng.choice([0.02, 1, 1, 8])
        v = [scale * rng.choice([-0.5, 0.25, 0.5, 0.5, rng.random()]) for _ in range(size)]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 9])))
    rows += [(700, [0.0] * 4, 1), (800, [1.0] * 4, 5), (900, [-1.0, 0.0, 0.0, 0.0], 0), (1000, [], 0), (1100, [0.5] * 4, -3),
             (701, None, 0), (702, [None, 1.0], 0), (703, [float("nan")] * 4, 0), (704, [float("inf"), 0.0], 0), (705, [1.0] * 4, None),
             (None, [1.0] * 4, 0)]
    rows += [(300, rows[300][1], rows[300][2]), (100, [0.1] * 4, 2), (41, rows[41][1], rows[41][2]), (41, rows[41][1], 8)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "group", "kind", "length", "anchor", "rank")})
    got = result(H.embeddings_mined(docs))
    assert got and got == expected(rows)
    assert result(H.embeddings_mined(docs.limit(0))) == []


def test_long_rows_of_large_whole_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1 << 18, 1 << 18, 300)], int(i % 3)) for i in range(120)]
    rows += [(i, [float(x) for x in rng.integers(1 << 13, 1 << 14, 20)], int(i % 3)) for i in range(200, 320)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(H.embeddings_mined(docs)) == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_pruning_drops_no_row_that_reaches_the_score(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-40, 40, (500, 6)) + (rng.integers(0, 5, 500) * 60)[:, None] * (np.arange(6) == seed)
    bucket = H.Bucket(np.arange(500), np.zeros(500, int), vectors)
    pruned = 0
    for a in vectors[:60]:
        score = vectors @ a
        length = np.sqrt((a.astype(float) ** 2).sum())
        for reach in (-5, 0, 1, np.median(score), np.sort(score)[-20], score.max(), score.max() + 1):
            rows = bucket.candidates(a, length, float(reach))
            if rows is not None:
                pruned += 1
                assert set(np.flatnonzero(score >= reach)) <= set(rows)
    assert pruned > 20
