"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (``a, b``): ``comp`` is the smallest node it can reach.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so
    the rounds grow with the logarithm of the longest path. Each round is stored, and only the number of
    changed rows comes to the driver. A hub is summed up on the map side, and its joins are skewed joins of
    unique keys, which adaptive execution splits.
    """
    both = freeze(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = freeze(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
                    .withColumn("comp", F.least("node", "comp")).withColumn("changed", F.lit(True)), "labels")
    while labels.filter("changed").limit(1).count():
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                                 F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = freeze(lower.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "old")
                        .select("node", "comp", (F.col("comp") != F.col("old")).alias("changed")), "labels")
    return labels.select("node", "comp")


def with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (of ``components``) after further ``links``: only links between components are followed."""
    known = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"of_{name}"))
    ends = (links.join(known("a"), "a", "left").join(known("b"), "b", "left")
            .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a != b").distinct())
    above = components(ends)
    new = above.select("node", F.col("node").alias("comp")).join(comps, "node", "left_anti")
    return (comps.unionByName(new).join(above.select(F.col("node").alias("comp"), F.col("comp").alias("above")), "comp", "left")
            .select("node", F.coalesce("above", "comp").alias("comp")))
