"""Parallel scans: the state before each row of a long sequence, by composing what blocks of rows do to a state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze

FAN = 512       # rows whose effects are composed in one task


def states_before(rows: DataFrame, key: str, place: str, effect: str, start: Column, state_type: str,
                  compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column],
                  out: str, fan: int = FAN) -> DataFrame:
    """``key, place, out``: the state before each row, where a key starts in ``start`` and a row changes it by ``effect``.

    ``compose(a, b)`` is the effect of ``a`` and then ``b``; ``apply(effect, state)`` the state behind it. ``place``
    counts the rows of a key from 0, with gaps or without. Effects are composed within runs of ``fan`` places, the
    runs of a key are scanned, and each run is scanned again from the state it starts with. So a key of n rows
    costs one task n / fan rows, and everything else is spread; a row stands for a block of the caller's already.
    """
    runs = freeze(
        rows.select(key, F.col(place).alias("_place"), F.col(effect).alias("_effect"))
        .groupBy(key, F.floor(F.col("_place") / fan).alias("_run"))
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_effect"))).alias("_rows"))
        .withColumn("_whole", F.aggregate(F.slice("_rows", 2, fan), F.col("_rows")[0]["_effect"],
                                          lambda acc, r: compose(acc, r["_effect"]))), "runs")

    def scanned(items: Column, state: Column, place_of: str, effect_of: str, place_type: str) -> Column:
        done = F.array().cast(f"array<struct<place:{place_type},state:{state_type}>>")
        step = lambda acc, r: F.struct(
            F.concat(acc["done"], F.array(F.struct(r[place_of].alias("place"), acc["state"].alias("state")))).cast(
                f"array<struct<place:{place_type},state:{state_type}>>").alias("done"),
            apply(r[effect_of], acc["state"]).cast(state_type).alias("state"))
        return F.aggregate(items, F.struct(done.alias("done"), state.cast(state_type).alias("state")), step, lambda acc: acc["done"])

    starts = (runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "_whole"))).alias("_runs"))
              .select(key, F.explode(scanned(F.col("_runs"), start, "_run", "_whole", "bigint")).alias("_s"))
              .select(key, F.col("_s.place").alias("_run"), F.col("_s.state").alias("_start")))
    kind = dict(rows.dtypes)[place]
    return (runs.join(starts, [key, "_run"])
            .select(key, F.explode(scanned(F.col("_rows"), F.col("_start"), "_place", "_effect", kind)).alias("_s"))
            .select(key, F.col("_s.place").alias(place), F.col("_s.state").alias(out)))
