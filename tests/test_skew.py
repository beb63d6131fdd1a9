import random

from pyspark.sql import functions as F

from doclake.operators import jobs, skew


def _rows(n, seed=7):
    rng = random.Random(seed)
    # one key and one instant each hold a third of the rows; None is a key like any other
    return [(i, "hot" if rng.random() < .4 else rng.choice([None, "a", "b", "c"]),
             5.0 if rng.random() < .4 else float(rng.randrange(50)), rng.randrange(4)) for i in range(n)]


def _expected(rows, keyed):
    totals, out = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        key = k if keyed else 0
        out[i] = totals.get(key, 0)
        totals[key] = out[i] + v
    return out


def test_running_total_with_hot_key(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "i int, k string, t double, v int").repartition(5)
    for keyed in (True, False):
        got = skew.running_total(df, ["k"] if keyed else [], [F.col("t"), F.col("i")], F.col("v"), "before", 100)
        assert {r.i: r.before for r in got.collect()} == _expected(rows, keyed)


def test_running_total_small_input(spark):
    rows = _rows(40)
    df = spark.createDataFrame(rows, "i int, k string, t double, v int")
    got = skew.running_total(df, ["k"], [F.col("t"), F.col("i")], F.col("v"), "before")
    assert {r.i: r.before for r in got.collect()} == _expected(rows, True)
    assert got.columns == ["i", "k", "t", "v", "before"]


def test_running_total_splits_the_hot_key(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "i int, k string, t double, v int")
    plan = skew.running_total(df, ["k"], [F.col("t"), F.col("i")], F.col("v"), "before")._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # the cut points are parsed once, at planning time
    assert "from_json" not in plan.split("== Optimized Logical Plan ==")[1]


def test_lookup_with_a_hot_key_needs_no_count(spark):
    """One key holds half of the rows; the plan is the plain join, whatever the sizes are."""
    left = spark.createDataFrame([(f"r{i}", "hot" if i % 2 else f"j{i}", "s1", True) for i in range(2000)],
                                 "request_id string, id string, session_id string, admin boolean")
    rows = [("hot", "s1", "a.pdf", "d1", "done"), ("j2", "s2", "b.pdf", "d2", "done"), ("j4", "s1", "c.pdf", "d3", "queued")]
    jobs_ = spark.createDataFrame(rows, "id string, session_id string, filename string, result_dir string, status string")
    got = jobs.owned(jobs_, left)
    assert "Union" not in got._jdf.queryExecution().toString()
    assert got.count() == 1001


def test_running_total_takes_one_path_at_every_size_and_setting(spark):
    rows = _rows(500)
    df = spark.createDataFrame(rows, "i int, k string, t double, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, per_bucket in (("8", 10), ("200", 10), ("8", 10**6)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = skew.running_total(df, ["k"], [F.col("t"), F.col("i")], F.col("v"), "before", per_bucket)
            plan = got._jdf.queryExecution().toString()
            assert "TakeOrdered" not in plan and "_bucket" in plan and plan.split("== Physical Plan ==")[1].count("Scan parquet") <= 4
            assert {r.i: r.before for r in got.collect()} == _expected(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
