import pytest
from pyspark.sql import functions as F

from doclake.operators.skew import running_totals
from doclake.sources.scratch import freeze, passing, scratch_path


def test_tables_of_a_block_go_at_its_end(spark):
    kept = freeze(spark.range(5), "kept")
    path = scratch_path(spark, "result")
    with passing(spark):
        outer = freeze(spark.range(7), "outer")
        with pytest.raises(ValueError), passing(spark):
            inner = freeze(spark.range(9), "inner")
            raise ValueError
        with pytest.raises(Exception, match="not exist|not found|FileNotFound"):
            inner.count()
        outer.filter("id > 3").write.parquet(path)
    assert kept.count() == 5 and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="not exist|not found|FileNotFound"):
        outer.count()


def test_several_totals_at_once(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 2).alias("x"))
    got = running_totals(rows, ["k"], [F.col("id")], {"n": F.lit(1), "sum": F.col("x")}, rows_per_bucket=7).collect()
    for r in got:
        before = [i for i in range(r.id) if i % 3 == r.k]
        assert (r.n, r["sum"]) == (len(before), 2 * sum(before))
