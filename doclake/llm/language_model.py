"""Scores of texts under a probabilistic suffix tree, beside a smoothed unigram model as a base.

The tree predicts the next byte of a text (A-Z lowered, words joined by one blank, one end) from the longest
context it holds. A context of up to ``DEPTH`` bytes is retained if it is frequent enough and its next-byte
distribution diverges enough from that of its parent, the context without its oldest byte. Distributions are
smoothed with the parent's, so every text has a positive probability.

Counts come from all training documents. Words and contexts are counted per block of documents first and summed
by Spark; what a block needs to know of its words comes back to it by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.texts import byte_slices, crc_fold, hashed_words
from doclake.sources.scratch import freeze

FOLDS, HELD_OUT = 7, 2
DEPTH = 5                 # longest context, in bytes
MIN_SHARE = 1e-5          # a context holds this share of all symbols: DEPTH / MIN_SHARE contexts at most
MIN_GAIN = 5e-7           # share x divergence from the parent (nats) that retains a context
SMOOTH = 4.0              # weight of the parent's distribution, in counts
BLOCK_ROWS = 4_000        # documents of a block, and bytes of their texts
BLOCK_BYTES = 6 << 20
SLICE, ROWS = 1 << 20, 500     # bytes and documents that are handled together, which bounds the working arrays
PART = 1 << 20            # symbols of a long text
GRAMS = 1 << 20           # counts that a task holds
END = 0                   # symbol of the end; also stands before the start
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r"))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and bounds: words parted by one blank, then one end.

    The byte 0 is read as 1, as 0 is the end.
    """
    out = []
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "replace").lower()
        out.append(b" ".join(raw.split()).replace(b"\x00", b"\x01") + b"\x00")
    bounds = np.cumsum([0] + [len(x) for x in out])
    return np.frombuffer(b"".join(out), np.uint8), bounds


def _contexts(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before each one, packed with the newest in the lowest byte; ends before the start."""
    code = np.zeros(len(s), np.uint64)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    offset = np.arange(len(s)) - start
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(s), np.uint64)
        before[k:] = s[:-k]
        before[offset < k] = END
        code |= before << np.uint64(8 * (k - 1))
    return code


def _parts(s: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and symbols of a run of texts, a bounded number at a time."""
    for at in range(0, len(s), PART):
        low = max(0, at - DEPTH)
        own = s[low:at + PART]
        inside = np.clip(bounds, low, low + len(own)) - low
        code = _contexts(own, np.unique(np.concatenate(([0], inside, [len(own)]))))
        yield code[at - low:], own[at - low:]


def context_counts(docs: DataFrame) -> DataFrame:
    """``code, symbol, n``: how often a symbol follows the ``DEPTH`` symbols packed in ``code``, over the training fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts):
            code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            code, inverse = np.unique(code, return_inverse=True)
            return code, np.bincount(inverse, n).astype(np.int64)

        def handed_on(parts):
            grams, n = counted(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array((grams >> np.uint64(8)).astype(np.int64)),
                 pa.array((grams & np.uint64(255)).astype(np.int32)), pa.array(n)], ["code", "symbol", "n"])
        for batch in batches:
            parts = []
            for part in byte_slices(batch, 1, SLICE, ROWS):
                keep = [crc_fold(i, FOLDS) != HELD_OUT for i in part.column(0).to_pylist()]
                part = part.filter(pa.array(keep, pa.bool_()))
                if part.num_rows:
                    for code, own in _parts(*symbols(part.column(1))):
                        grams = np.sort(code << np.uint64(8) | own)
                        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                        parts.append((grams[first], np.diff(np.append(first, len(grams)))))
                if sum(len(p[0]) for p in parts) > GRAMS:
                    yield handed_on(parts)
                    parts = []
            if parts:
                yield handed_on(parts)
    return docs.mapInArrow(run, "code long, symbol int, n long").groupBy("code", "symbol").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Retained contexts as a table of children (by the next older symbol) and log10 probabilities.

    Both have a column for each symbol of the training fold and one for all others, which are equally likely.
    """

    def __init__(self, child: np.ndarray, prob: np.ndarray, seen: np.ndarray):
        self.column = np.full(256, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        other = np.setdiff1d(np.arange(256), seen)[:1]
        kept = np.append(seen, other)
        self.child = np.ascontiguousarray(child[:, kept])
        self.log_p = np.log10(prob[:, kept]).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text: the longest retained suffix of the symbols before predicts each one."""
        s, bounds = symbols(texts)
        out, at = np.empty(len(s)), 0
        for code, own in _parts(s, bounds):
            state = np.zeros(len(code), np.int32)
            live = np.arange(len(code))
            for k in range(DEPTH):
                older = ((code[live] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
                step = self.child[state[live], self.column[older]]
                live = live[step > 0]
                state[live] = step[step > 0]
            out[at:at + len(code)] = self.log_p[state, self.column[own]]
            at += len(code)
        total = np.concatenate(([0.0], np.cumsum(out)))
        return total[bounds[1:]] - total[bounds[:-1]]


def grow(docs: DataFrame) -> SuffixTree:
    """The tree of the training fold.

    Contexts of each length are summed from the longest ones. Those below ``MIN_SHARE`` of all symbols go before
    anything reaches the driver, so at most DEPTH / MIN_SHARE contexts do, whatever the corpus is.
    """
    full = freeze(context_counts(docs), "contexts")
    total = full.agg(F.sum("n")).first()[0] or 0
    rows: dict[tuple[int, int], dict[int, int]] = {}
    for depth in range(DEPTH + 1):
        own = full.groupBy(F.col("code").bitwiseAND((1 << 8 * depth) - 1).alias("context"), "symbol").agg(F.sum("n").alias("n"))
        frequent = own.groupBy("context").agg(F.sum("n").alias("all")).filter(F.col("all") >= MIN_SHARE * total)
        got = own.join(frequent.select("context"), "context", "left_semi").toPandas()
        for c, s, n in zip(got["context"].to_numpy(), got["symbol"].to_numpy(), got["n"].to_numpy()):
            rows.setdefault((depth, int(c)), {})[int(s)] = int(n)

    child, prob = [np.zeros(256, np.int32)], []
    place = {(0, 0): 0}
    counts = np.zeros(256)
    for s, n in rows.get((0, 0), {}).items():
        counts[s] = n
    prob.append((counts + 1 / 256) / (counts.sum() + 1))
    for depth in range(1, DEPTH + 1):
        for (d, code) in sorted(k for k in rows if k[0] == depth):
            parent = place.get((depth - 1, code & ((1 << 8 * (depth - 1)) - 1)))
            if parent is None:      # its parent was not retained: longer contexts hang on retained ones only
                continue
            counts = np.zeros(256)
            for s, n in rows[(d, code)].items():
                counts[s] = n
            p = (counts + SMOOTH * prob[parent]) / (counts.sum() + SMOOTH)
            gain = counts.sum() / total * float((p * np.log(p / prob[parent])).sum())
            if gain >= MIN_GAIN:
                place[(depth, code)] = len(prob)
                child[parent][code >> 8 * (depth - 1) & 255] = len(prob)
                child.append(np.zeros(256, np.int32))
                prob.append(p)
    return SuffixTree(np.array(child), np.array(prob), np.array(sorted(rows.get((0, 0), {})), np.int64))


def word_blocks(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """Per block of documents: its distinct word hashes, their counts in the training fold, its documents' words and scores.

    ``words``: 64-bit hashes, ascending; ``train``: counts; ``ids``: the documents; ``scores``: of the tree; ``ends``:
    where a document's entries end in ``places`` (numbers into ``words``, one for each distinct word) and ``times``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, BLOCK_BYTES, BLOCK_ROWS):
                ids = part.column(0).to_pylist()
                h, bounds = hashed_words(part.column(1))
                words, place = np.unique(h, return_inverse=True)
                row = np.repeat(np.arange(len(ids)), np.diff(bounds))
                key, times = np.unique(row << 32 | place, return_counts=True)
                train = np.array([crc_fold(i, FOLDS) != HELD_OUT for i in ids], bool)
                row, place = key >> 32, key & 0xFFFFFFFF
                counts = np.bincount(place, times * train[row], minlength=len(words)).astype("<i8")
                yield pa.RecordBatch.from_pydict({
                    "words": [words.astype("<u8").tobytes()], "n_words": [len(words)], "train": [counts.tobytes()],
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "scores": [np.concatenate([tree.scores(x.column(1)) for x in byte_slices(part, 1, SLICE, ROWS)]).astype("<f8").tobytes()],
                    "ends": [np.searchsorted(row, np.arange(len(ids)), "right").astype("<i8").tobytes()],
                    "places": [place.astype("<i4").tobytes()], "times": [times.astype("<i4").tobytes()],
                    "train_ends": [int(train.sum())]})
    return docs.mapInArrow(run, "words binary, n_words long, train binary, ids array<long>, scores binary, ends binary, places binary, times binary, "
                                "train_ends long")


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Documents whose crc32 of the id mod 7 is 2 are held out of all counts; a null id counts as an empty text.
    Tokens are the words and one end per document, so null and empty texts have one token. ``base_score`` adds
    log10((c + 1) / (N + V + 1)) over the tokens, ``score`` is the tree's log10 probability of the text. Repeated
    rows count and are scored each, texts of any length whole. Without training documents every count is 0 and the tree is uniform. An empty
    table gives an empty result.

    The count of a word is summed over blocks on the map side and joined back to the blocks that hold it, so a
    word of every document costs one row per block, not one per document.
    """
    docs = docs.select("doc_id", "text")
    tree = grow(docs)
    blocks = freeze(word_blocks(docs, tree).withColumn("block", F.monotonically_increasing_id()), "blocks")

    def spread(batches):
        for batch in batches:
            for block, words, train in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = np.frombuffer(words, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)),
                     pa.array(words), pa.array(np.frombuffer(train, "<i8"))], ["block", "slot", "word", "n"])
    held = blocks.select("block", "words", "train").mapInArrow(spread, "block long, slot int, word long, n long")
    counts = freeze(held.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "words")
    ends = blocks.agg(F.sum("train_ends")).first()[0] or 0
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)         # the end is a token, and a distinct one
    known = held.select("block", "slot", "word").join(counts, "word").select("block", "slot", "c")

    def score(key, block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        c = np.zeros(row["n_words"])
        c[found.column("slot").to_numpy()] = found.column("c").to_numpy()
        places, times = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["times"], "<i4")
        last = np.frombuffer(row["ends"], "<i8")
        own = lambda values: np.diff(np.concatenate(([0.0], np.cumsum(values)))[np.concatenate(([0], last))])
        tokens = own(times) + 1
        logs = own(times * np.log10(c[places] + 1)) + np.log10(ends + 1)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()),
            "held_out": pa.array([crc_fold(i, FOLDS) == HELD_OUT for i in row["ids"]], pa.bool_()),
            "n_tokens": pa.array(tokens.astype(np.int64)),
            "n_known": pa.array((own(times * (c[places] > 0)) + (ends > 0)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(last), n, np.int64)),
            "base_score": pa.array(logs - tokens * np.log10(n + v + 1)),
            "score": pa.array(np.frombuffer(row["scores"], "<f8"))})
    parts = blocks.drop("words", "train", "train_ends").groupBy("block").cogroup(known.groupBy("block"))
    return parts.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double")
