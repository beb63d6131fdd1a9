"""Building blocks that stay exact and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze

ROWS_PER_BUCKET = 200_000     # rows that one window task sorts


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come earlier in ``order``."""
    return running_totals(df, keys, order, {out: value}, rows_per_bucket)


def running_totals(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column],
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add a column per entry of ``values``: the sum of the value over the rows of the same ``keys`` that come earlier.

    ``order`` must be total within a key. A plain window would put all rows of a key into one task. Here the
    rows are partitioned by range along (keys, order), in as many ranges as the number of rows asks for, and
    stored once, so that a recomputed task sees the same ranges. A window sums within each range and key, and
    the totals of the earlier ranges of the same key are added. Only these totals meet by key: one row per
    range and key, of which a range shares at most one key with the range before it.
    """
    order_names = [f"_order{i}" for i in range(len(order))]
    value_names = {out: f"_value{i}" for i, out in enumerate(values)}
    rows = df.withColumns(dict(zip(order_names, order)) | {value_names[out]: value for out, value in values.items()})
    ranges = 1 + df.count() // rows_per_bucket
    rows = freeze(rows.repartitionByRange(ranges, *keys, *order_names)
                  .withColumn("_bucket", F.spark_partition_id()), "ranges")

    earlier = Window.orderBy(*order_names).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset_names = {out: f"_offset{i}" for i, out in enumerate(values)}
    sums = rows.groupBy(*keys, "_bucket").agg(*[F.sum(value_names[out]).alias(offset_names[out]) for out in values])
    offsets = (sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_bucket").alias("_o_bucket"),
                           *[F.sum(o).over(before).alias(o) for o in offset_names.values()])
               .filter(reduce(or_, [F.col(o) != 0 for o in offset_names.values()])))
    match = F.col("_bucket") == F.col("_o_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    zero = F.lit(0)
    within = {out: F.coalesce(F.sum(value_names[out]).over(earlier.partitionBy(*keys, "_bucket")), zero) for out in values}
    return (rows.withColumns(within).join(offsets, match, "left")
            .withColumns({out: F.col(out) + F.coalesce(offset_names[out], zero) for out in values})
            .select(*df.columns, *values))
