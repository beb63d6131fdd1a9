"""Quality of documents by a regularised quadratic discriminant.

Statistics of each text are brought to comparable scales by fixed transformations. The two classes get a mean
and a covariance each, shrunk towards the pooled covariance and its diagonal. A score is the difference of the
log densities, from Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from doclake.llm.texts import crc_fold, hashed_words, mixed
from doclake.sources.scratch import freeze

FOLDS, HELD_OUT = 3, 1
POOLED, DIAGONAL = 0.2, 0.05     # shrinkage of a class covariance: towards the pooled one, and of both to its diagonal
FLOOR = 1e-2                     # least variance of a transformed statistic
SOFTNESS = 20.0                  # difference of log densities at which a score is 3/4
MIN_ROWS = 10                    # a class with fewer labelled rows has no density of its own

STATISTICS = [
    "n_words", "word_length", "symbols", "pipes", "punctuation", "exclamations", "digits", "capitals", "non_ascii",
    "distinct_words", "repeated_next", "repeated_windows", "short_lines", "top_word", "line_ends",
]
_CLASS = {
    "symbols": b"#*$%&<>", "pipes": b"|", "punctuation": b".,;:?", "exclamations": b"!",
    "digits": b"0123456789", "capitals": bytes(range(65, 91)), "non_ascii": bytes(range(128, 256)),
}
_MEMBER = np.array([[c in chars for c in range(256)] for chars in _CLASS.values()]).T.astype(np.int64)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; null and empty texts have those of no words."""
    h, bounds = hashed_words(texts)
    window = h[:max(0, len(h) - 4)].copy()
    for k in range(1, 5):
        window = mixed(window) + h[k:k + len(window)]
    rows = []
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        raw = (text.as_py() or "").encode("utf-8", "replace")
        size, n = max(1, len(raw)), int(b - a)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = dict(zip(_CLASS, (counts @ _MEMBER) / size))
        _, times = np.unique(h[a:b], return_counts=True)
        blanks = int(counts[32] + counts[9:14].sum())
        lines = [x for x in re.split(rb"\n", raw) if x.strip()]
        windows = max(0, n - 4)
        logit = lambda x: float(np.log((x + 0.002) / (1.002 - x)))
        rows.append([
            float(np.log1p(n)), float(np.log1p((size - blanks) / max(1, n))),
            *[logit(min(1.0, v)) for v in share.values()],
            logit(len(times) / max(1, n)) - 0.3 * float(np.log1p(n)),     # long texts repeat more words
            logit((h[a:b][1:] == h[a:b][:-1]).mean() if n > 1 else 0.0),
            logit(1 - len(np.unique(window[a:a + windows])) / windows if windows else 0.0),
            logit(sum(len(x) < 30 for x in lines) / max(1, len(lines))),
            logit(times.max() / n if n else 0.0),
            float(np.log1p(len(lines))),
        ])
    return np.array(rows, np.float64).reshape(-1, len(STATISTICS))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the transformed statistics of each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x = statistics(part.column(1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])
    frame = docs.select("doc_id", "text")
    return frame.mapInArrow(run, frame.select("doc_id").schema.add("x", ArrayType(DoubleType())))


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes."""
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_det: list[float]
    log_prior: list[float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, priors included, per row of ``x``."""
        out = []
        for m, factor, log_det, prior in zip(self.mean, self.factor, self.log_det, self.log_prior):
            z = np.linalg.solve(factor, (x - m).T)
            out.append(prior - 0.5 * ((z * z).sum(axis=0) + log_det))
        return out[1] - out[0]


def fit(rows: DataFrame) -> Discriminant | None:
    """The discriminant of ``x, label`` (0 or 1), from sums that the tasks send; None if a class is too small."""
    d = len(STATISTICS)

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).values.to_numpy().reshape(-1, d)
                y = batch.column(1).to_numpy()
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        place = np.tile(np.arange(total.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]).astype(np.int32)),
                                          pa.array(place.astype(np.int32)), pa.array(total.ravel())], ["c", "k", "v"])
    # a fixed number of sums, whatever the number of rows is
    got = rows.select("x", "label").mapInArrow(sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for c, k, v in got:
        total[c, k] = v
    n = total[:, 0]
    if n.min() < MIN_ROWS:
        return None
    mean = [t[1:1 + d] / t[0] for t in total]
    cov = [t[1 + d:].reshape(d, d) / t[0] - np.outer(m, m) for t, m in zip(total, mean)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    out = Discriminant(mean, [], [], [float(np.log(k / n.sum())) for k in n])
    for c in cov:
        c = (1 - POOLED) * c + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(c)
        out.factor.append(factor)
        out.log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    ``labels`` (``doc_id, quality``) are learned outside the held-out fold only, which the crc32 of the id gives;
    labels other than 0 and 1 are ignored, repeated or contradictory ones count each. Only the text enters a
    score. Null and empty texts are scored as texts of no words. If a class has fewer than ``MIN_ROWS`` labelled
    rows, nothing can be told apart and every score is 0.5. Repeated rows are scored each; null ids are never
    labelled. Texts of any length are read whole, an empty table gives an empty result. The score rises with the difference of the log densities and is 0.5 where they are equal.
    """
    rows = freeze(measured(docs), "statistics")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(rows.filter(fold != HELD_OUT).join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).values.to_numpy().reshape(-1, len(STATISTICS))
            z = model.difference(x) if model and len(x) else np.zeros(len(x))
            # never saturates, so that scores keep their order far from the border
            score = 0.5 + 0.5 * z / (np.abs(z) + SOFTNESS)
            held = [crc_fold(i, FOLDS) == HELD_OUT for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("held_out", "boolean").add("score", "double")
                           .add("predicted", "integer"))
