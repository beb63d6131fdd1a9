"""Hard negatives by exact inner-product search with coordinate pruning over length buckets.

Rows are ordered by label and length, dealt into groups, and cut into buckets of rows of similar length. A bucket
keeps, per coordinate, its rows sorted by that coordinate of the unit vector. An anchor with a score to reach
needs at least a certain cosine in a bucket; that confines each coordinate to an interval around the anchor's.
The intervals of the anchor's largest (focus) coordinates are looked up in the sorted lists, and only rows in all
of them are verified by their exact integer score. A bucket that is too short is skipped, one in which the
intervals hold nearly all rows is verified as a whole.

The search runs twice: for the positives of an anchor among the groups with its label, then for the negatives
among all groups. In between, a sixteenth of the rows is searched for negatives: the last rank it gives is a lower
bound for every group, which prunes and keeps partial results few. It drops nothing that can be among the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze

GROUP_ROWS = 1 << 17        # rows whose buckets are in memory at once
BUCKET_ROWS = 4096
ANCHOR_ROWS = 256           # anchors that are scored together
FOCUS = 3
NEARLY_ALL = 0.5            # above this share of a bucket, verifying it whole costs less than intersecting
PROBE = 16                  # one in so many rows gives the first bound
LEAST = -(1 << 62)


@dataclass(frozen=True)
class Rule:
    """What counts: ranks kept, and the share of the positive's score that a negative may have, in hundredths."""
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


# --- inside a task ------------------------------------------------------------

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where no sum can lose a digit."""
    if len(a) == 0 or len(b) == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = np.sqrt((a.astype(float) ** 2).sum(1).max()) * np.sqrt((b.astype(float) ** 2).sum(1).max())
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Bucket:
    """Rows of similar length with sorted coordinate lists, made when an anchor first focuses on a coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.longest = float(self.lengths.max())
        self.one_label = labels[0] if (labels == labels[0]).all() else None
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            unit = self.vectors[:, f] / np.where(self.lengths > 0, self.lengths, 1)
            order = np.argsort(unit, kind="stable").astype(np.int32)
            self.lists[f] = unit[order], order
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, length: float, reach: float) -> np.ndarray | None:
        """Rows that can score ``reach`` with the anchor; None: any row can, as far as the lists tell."""
        if reach <= 0 or length == 0:
            return None if reach <= 0 else np.empty(0, np.int64)
        cosine = reach / (length * self.longest) if self.longest else 2.0
        if cosine > 1 + 1e-9:
            return np.empty(0, np.int64)
        wide = np.arccos(min(1.0, cosine))
        focus = np.argsort(-np.abs(anchor))[:FOCUS]
        found = []
        for f in focus:
            angle = np.arccos(np.clip(anchor[f] / length, -1, 1))
            low, high = np.cos(min(np.pi, angle + wide)) - 1e-9, np.cos(max(0.0, angle - wide)) + 1e-9
            values, order = self.sorted_by(int(f))
            found.append(order[np.searchsorted(values, low):np.searchsorted(values, high, "right")])
        found.sort(key=len)
        if len(found[0]) > NEARLY_ALL * len(self.ids):
            return None
        seen = np.zeros(len(self.ids), np.int8)
        for rows in found:
            seen[rows] += 1
        return np.flatnonzero(seen == len(found))


def buckets_of(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    """Buckets of rows that come sorted by label and length; the longest first, so that bounds rise early."""
    cut = range(0, len(ids), BUCKET_ROWS)
    out = [Bucket(ids[i:i + BUCKET_ROWS], labels[i:i + BUCKET_ROWS], vectors[i:i + BUCKET_ROWS]) for i in cut]
    return sorted(out, key=lambda b: -b.longest)


@dataclass
class Anchors:
    """Anchors in a task. ``low`` and ``high`` bound the scores per anchor and target; a target keeps ``keep`` rows."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    keep: int
    found: list = field(default_factory=list)

    def __post_init__(self):
        self.lengths = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        self.found = [np.empty((0, 3), np.int64) for _ in range(self.low.shape[1])]    # anchor, score, id

    def search(self, bucket: Bucket) -> None:
        if bucket.one_label is not None:
            can = (self.labels == bucket.one_label) == self.same
        else:
            can = np.ones(len(self.ids), bool)
        reach = np.where(self.low <= self.high, self.low, 1 << 62).min(1)
        at = np.flatnonzero(can & (reach < 1 << 62))
        whole, pairs = [], []
        for a in at:
            rows = bucket.candidates(self.vectors[a], self.lengths[a], float(reach[a]))
            if rows is None:
                whole.append(a)
            elif len(rows):
                pairs.append((np.full(len(rows), a), rows, products(self.vectors[a:a + 1], bucket.vectors[rows])[0]))
        if whole:
            whole = np.array(whole)
            score = products(self.vectors[whole], bucket.vectors)
            i, rows = np.nonzero(score >= reach[whole][:, None])
            pairs.append((whole[i], rows, score[i, rows]))
        if not pairs:
            return
        anchor, rows, score = (np.concatenate(x) for x in zip(*pairs))
        fits = ((self.labels[anchor] == bucket.labels[rows]) == self.same) & (self.ids[anchor] != bucket.ids[rows])
        anchor, rows, score = anchor[fits], rows[fits], score[fits]
        for target in range(self.low.shape[1]):
            ok = (score >= self.low[anchor, target]) & (score <= self.high[anchor, target])
            if ok.any():
                self._keep(target, np.stack([anchor[ok], score[ok], bucket.ids[rows[ok]]], 1))

    def _keep(self, target: int, more: np.ndarray) -> None:
        """Merge rows into the best of a target; a full list raises the score to reach (a tie may still get in)."""
        rows = np.concatenate([self.found[target], more])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - start
        self.found[target] = rows[place < self.keep]
        last = rows[place == self.keep - 1]
        self.low[last[:, 0], target] = np.maximum(self.low[last[:, 0], target], last[:, 1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one width; what a shorter list lacks counts as zero."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    kind = np.int32 if len(values) == 0 or np.abs(values).max() < 1 << 30 else np.int64
    out = np.zeros((len(sizes), width), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


# --- rows, groups and searches as DataFrames ----------------------------------

def prepared(rows: DataFrame, id_col: str, label: Column, vector: Column, scale: int) -> DataFrame:
    """``id, label, v``: whole-number components ``floor(scale * x)`` of the rows that take part.

    A null id, label or vector, or a null, infinite or missing-value component keeps a row out. Components beyond
    64 bits take the nearest value that fits; scores have to fit 64 bits.
    """
    usable = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (rows.filter(rows[f"`{id_col}`"].isNotNull() & label.isNotNull() & F.coalesce(usable, F.lit(False)))
            .select(rows[f"`{id_col}`"].cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def grouped(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``group``, in order of label and length over all groups, stored; and the number of groups."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP_ROWS))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stored = freeze(rows.withColumn("length", squares).repartitionByRange(n, "label", "length", "id")
                    .withColumn("group", F.spark_partition_id()), "vectors")
    return stored, n


def search(rows: DataFrame, anchors: DataFrame, groups: int, width: int, same: bool, keep: int) -> DataFrame:
    """``anchor, target, score, id``: per group, the best rows of each target of an anchor.

    ``anchors``: ``group, id, label, v, low array<long>, high array<long>``, a row for each group to search.
    """
    none = F.lit(None).cast("array<bigint>")
    both = (rows.select("group", F.lit(0).alias("kind"), "label", "length", "id", "v", none.alias("low"), none.alias("high"))
            .unionByName(anchors.select("group", F.lit(1).alias("kind"), "label", F.lit(0.0).alias("length"), "id", "v", "low", "high")))
    dealt = (both.repartition(groups, "group").sortWithinPartitions("group", "kind", "label", "length", "id")
             .select("group", "kind", "label", "id", "v", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, buckets = None, [], None
        for batch in batches:
            marks = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(marks, prepend=-1, append=-1))
            for start, stop in zip(edges[:-1], edges[1:]):
                part = batch.slice(int(start), int(stop - start))
                if part.column(0)[0].as_py() != group:
                    group, parts, buckets = part.column(0)[0].as_py(), [], None
                ids, labels = part.column(3).to_numpy(), part.column(2).to_numpy()
                vectors = _matrix(part.column(4), width)
                if marks[start] % 2 == 0:
                    parts.append((ids, labels, vectors))
                    continue
                if buckets is None:
                    buckets = buckets_of(*(np.concatenate(x) for x in zip(*parts))) if parts else []
                    parts = []
                low, high = (np.array(part.column(c).to_pylist(), np.int64).reshape(len(ids), -1) for c in (5, 6))
                for i in range(0, len(ids), ANCHOR_ROWS):
                    cut = slice(i, i + ANCHOR_ROWS)
                    block = Anchors(ids[cut], labels[cut], vectors[cut], low[cut].copy(), high[cut], same, keep)
                    for bucket in buckets:
                        block.search(bucket)
                    for target, rows_ in enumerate(block.found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(block.ids[rows_[:, 0]]), pa.array(np.full(len(rows_), target, np.int32)),
                             pa.array(rows_[:, 1]), pa.array(rows_[:, 2])], ["anchor", "target", "score", "id"])
    return dealt.mapInArrow(run, "anchor long, target int, score long, id long")


def first(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows of each target with their ``rank``."""
    order = Window.partitionBy("anchor", "target").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mined(rows: DataFrame, is_anchor: Column, rule: Rule = Rule()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``id, label, v``.

    The positives of an anchor are its best ``rule.positives`` rows of other ids with its label; the negatives of a
    positive the best ``rule.negatives`` rows of other labels (and ids) whose score is between ``rule.low`` and
    ``rule.high`` hundredths of the positive's. Equal scores come in order of id. Repeated rows count as often as
    they stand; of several anchors of one id the one of the smallest label and vector counts. Vectors of unequal
    size are compared as if the shorter one ended in zeros. Anchors without positives, and positives without
    negatives, have no rows; neither has an empty table.
    """
    width = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rows, groups = grouped(rows)
    anchors = freeze(rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "anchors")

    bounds = lambda n, value: F.array_repeat(F.lit(value).cast("long"), n)
    with_label = rows.select("label", "group").distinct()
    own = anchors.join(with_label, "label").withColumns({"low": bounds(1, LEAST), "high": bounds(1, -LEAST)})
    best = first(search(rows, own, groups, width, True, rule.positives), rule.positives)
    positives = freeze(best.select("anchor", (F.col("rank") - 1).alias("target"), F.col("score").alias("positive_score"),
                                   F.col("id").alias("positive_id")), "positives")

    # low * p <= 100 * s <= high * p, in whole numbers
    share = lambda hundredths: F.col("positive_score").cast("decimal(20,0)") * hundredths / 100
    targets = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "target", F.ceil(share(rule.low)).cast("long").alias("low"), F.floor(share(rule.high)).cast("long").alias("high")))).alias("t"))
    pad = lambda side, value: F.concat(F.transform("t", lambda x: x[side]), F.array_repeat(F.lit(value).cast("long"), F.lit(rule.positives) - F.size("t")))
    asked = anchors.join(targets, F.col("id") == F.col("anchor")).select(
        "id", "label", "v", pad("low", 1).alias("low"), pad("high", 0).alias("high"))

    # the first bound: the last rank among a part of the rows
    n_probe = -(-groups // PROBE)
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).withColumn("group", F.expr(f"group div {PROBE}"))
    probed = first(search(part, _to_all(asked, n_probe), n_probe, width, False, rule.negatives), rule.negatives)
    least = (probed.filter(F.col("rank") == rule.negatives).groupBy("anchor")
             .agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("least")))
    asked = freeze(asked.join(least, F.col("id") == F.col("anchor"), "left").withColumn(
        "low", F.transform("low", lambda x, i: F.greatest(x, F.col("least")[i]))).select("id", "label", "v", "low", "high"), "asked")

    found = first(search(rows, _to_all(asked, groups), groups, width, False, rule.negatives), rule.negatives)
    return found.join(positives, ["anchor", "target"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _to_all(anchors: DataFrame, groups: int) -> DataFrame:
    """Each anchor once for every group: a stated set of queries against all rows, in blocks."""
    return anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def embeddings_mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the ids divisible by 100; labels of ids divisible by 7 are moved on by one of ten first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(embeddings, "vec_id", label, F.col("embedding"), 256)
    return mined(rows, F.col("id") % 100 == 0)
