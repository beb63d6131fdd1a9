"""Documents that contain benchmark passages, verbatim or reworded.

Texts are searched by windows of words, weighted by TF-IDF with document frequencies of the whole corpus. Items are
cut into passages of about a window's length. A randomised SVD gives a latent space for each block of passages. Every
window of every document whose words can add up to a candidate is folded into it and compared with the passages by
cosine; candidates are settled on the whole item by the longest common subsequence of words and a check of the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.texts import alnum_tokens, hashed_words, word_hash

BITS = 18               # document frequencies are counted in 2^18 hashed cells, 1 MB for every task
STRIDE = 16             # windows have two strides, so each word lies in two
PASSAGE = 48            # words of an item that are searched together; longer items are cut evenly, so half at least
BLOCK_ITEMS = 160       # passages of items that share a latent space
RANK, EXTRA = 192, 16   # dimensions kept at most, and more for the random range
MAX_SHARE = 0.05        # words of more documents than this share are common; they weigh less, but never 0
MIN_COSINE = 0.3
MIN_PART = 0.4          # or this part of an item's own length lies in the window, however much else does
VERBATIM, REWORDED, ANSWER = 0.8, 0.5, 0.6      # shares of an item's words
MIN_ITEM = 8            # items with fewer words must stand as they are
SLICE_ROWS = 1_000      # texts that a task works on together
SLACK = 1e-3            # part by which rounding may lift a folded window over the sum of its words


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(column), SLICE_ROWS):
        yield column.slice(at, SLICE_ROWS)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def document_weights(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and the idf of each hashed cell, which is positive for every word.

    The counts cover the whole corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for part in _slices(batch.column(0)):
                h, bounds = hashed_words(part, alnum=True)
                key = np.sort(np.repeat(np.arange(len(part)), np.diff(bounds)) << BITS | _cells(h))
                if len(key):
                    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
                total += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()),
                                          pa.array([n, *total[used].tolist()], pa.int64())], ["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[cell[cell >= 0]] = n[cell >= 0]
    size = int(n[cell < 0].sum())
    return size, np.log((2 + size) / (1 + df)).astype(np.float32)


def common_idf(size: int) -> float:
    """The least idf of a word that is not common. In a corpus of few documents no word is common."""
    return float(np.log((2 + size) / (1 + max(20, MAX_SHARE * size))))


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: set[int]
    content: set[int]


def read_items(rows, idf: np.ndarray, least: float = 0.0) -> list[Item]:
    """Items that have words. The answer is the column of that name, else the last sentence.

    Content are the words with an idf of ``least``, or all words where these are less than a quarter: a passage
    that so many documents carry that its own words are common has content like any other.
    """
    items = []
    for r in rows:
        words = word_hash(alnum_tokens(r["text"]))
        if len(words):
            answer = r["answer"] if "answer" in r and r["answer"] else re.split(r"[.?!]\s+", r["text"].strip())[-1]
            answer = word_hash(alnum_tokens(answer)).tolist()
            content = words[idf[_cells(words)] >= least]
            if len(content) < max(MIN_ITEM // 2, len(words) / 4):
                content = words
            items.append(Item(r["item_id"], words, set(answer or words.tolist()), set(content.tolist())))
    return items


@dataclass
class Passage:
    item: Item
    words: np.ndarray


def passages(item: Item) -> list[Passage]:
    """The item in even parts of ``PASSAGE`` words at most: what holds a share of it holds that share of some part."""
    return [Passage(item, x) for x in np.array_split(item.words, -(-len(item.words) // PASSAGE))]


class Windows:
    """The windows of some texts as vectors over the vocabulary of a block of items."""

    def __init__(self, items: list[Item] | list[Passage], idf: np.ndarray):
        self.idf = idf
        self.vocabulary = np.unique(np.concatenate([x.words for x in items]))
        self.weight = idf[_cells(self.vocabulary)]
        self.in_cell = np.zeros(1 << BITS, bool)
        self.in_cell[_cells(self.vocabulary)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, else -1."""
        out = np.full(len(h), -1, np.int64)
        near = np.flatnonzero(self.in_cell[_cells(h)])
        if len(near):
            at = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h[near]
            out[near[same]] = at[same]
        return out

    def bounds(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each window; ``texts`` has the bounds of the rows. One window for a short text."""
        size = np.diff(texts)
        count = np.where(size > 0, np.maximum(1, -(-size // STRIDE) - 1), 0)
        row = np.repeat(np.arange(len(size)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = texts[row] + step * STRIDE
        return row, start, np.minimum(start + 2 * STRIDE, texts[row + 1])

    def lengths(self, h: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Squared length of each window, and the part of it that the vocabulary has, by running sums."""
        mass = self.idf[_cells(h)].astype(np.float64) ** 2
        whole, own = (np.concatenate(([0.0], np.cumsum(m))) for m in (mass, np.where(number >= 0, mass, 0.0)))
        return whole[end] - whole[start], own[end] - own[start]

    def folded(self, number: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Each window times ``base`` (vocabulary x dimensions)."""
        known = np.flatnonzero(number >= 0)
        first, last = np.searchsorted(known, start), np.searchsorted(known, end)
        out = np.zeros((len(start), base.shape[1]), np.float32)
        for at in range(0, len(start), 2048):      # bounds the gathered rows
            a, b = first[at:at + 2048], last[at:at + 2048]
            size = b - a
            full = np.flatnonzero(size)
            if len(full):
                begin = np.cumsum(size[full]) - size[full]
                places = np.arange(size[full].sum()) - np.repeat(begin, size[full]) + np.repeat(a[full], size[full])
                words = number[known[places]]
                out[at + full] = np.add.reduceat(base[words] * self.weight[words, None], begin, axis=0)
        return out

    def summed(self, number: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum of ``value`` (one of each word of the vocabulary) over each window."""
        total = np.concatenate(([0.0], np.cumsum(np.append(value, 0.0)[number])))      # -1, no word of it, takes the 0
        return total[end] - total[start]


def shared_windows(docs: DataFrame, windows: Windows) -> tuple[int, np.ndarray]:
    """Number of windows of all ``docs``, and C'C for their word counts C (windows x vocabulary).

    Two words share the windows of their stride, or the one that covers the strides of both. Pairs are counted per
    task and summed by Spark; the driver gets at most half of the vocabulary squared, which the item block bounds.
    """
    size = len(windows.vocabulary)

    def run(batches):
        counts, n, words = np.zeros(size * (size + 1), np.int32), 0, 0     # the last ``size`` cells: words with themselves

        def summed() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], used)), pa.int64()),
                                               pa.array(np.concatenate(([n], counts[used])), pa.int64())], ["cell", "n"])
        for batch in batches:
            for part in _slices(batch.column(0)):
                h, texts = hashed_words(part, alnum=True)
                strides = -(-np.diff(texts) // STRIDE)
                n += int(np.where(strides > 0, np.maximum(1, strides - 1), 0).sum())
                if words and words + len(h) > 1 << 24:      # a word adds 62 to a cell at most
                    yield summed()
                    counts[:], n, words = 0, 0, 0
                words += len(h)
                number = windows.numbers(h)
                own = np.flatnonzero(number >= 0)
                number, row = number[own], np.searchsorted(texts, own, "right") - 1
                stride = (own - texts[row]) // STRIDE
                shared = ((stride >= 1).astype(np.int32) + (stride <= np.maximum(1, strides[row] - 1) - 1))
                stride += (np.cumsum(strides + 2) - strides)[row]      # apart between texts
                np.add.at(counts, size * size + number, shared)
                for d in range(1, 2 * STRIDE):
                    apart = stride[d:] - stride[:-d]
                    k = np.flatnonzero(apart <= 1)
                    if not len(k):
                        break
                    low, high = np.minimum(number[k], number[k + d]), np.maximum(number[k], number[k + d])
                    np.add.at(counts, low * size + high, np.where(apart[k] == 0, shared[k], np.int32(1)))
        yield summed()
    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    pairs, own, alone = np.zeros((size, size)), cell >= size * size, cell < 0
    low, high = np.divmod(cell[~own & ~alone], size)
    pairs[low, high] = n[~own & ~alone]
    pairs[high, low] += n[~own & ~alone]        # each cell comes once; two of one word count both ways
    pairs[cell[own] - size * size, cell[own] - size * size] += n[own]
    return int(n[alone].sum()), pairs


def latent_space(items: list[Item] | list[Passage], windows: Windows, docs: DataFrame) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the items and all windows of ``docs``, by randomised SVD.

    One pass over the documents gives A'A, from which the driver takes a random range and the small matrix of A on it.
    Items count with unit length, so that short ones are not lost, and the windows together with a tenth of their weight.
    """
    size = len(windows.vocabulary)
    rank = min(RANK + EXTRA, size, len(items) * 5 // 4 + EXTRA)
    n, shared = shared_windows(docs, windows) if size else (0, None)

    def summed(base: np.ndarray) -> np.ndarray:
        total = windows.weight[:, None] * (shared @ (windows.weight[:, None] * base))
        words, ends = np.concatenate([x.words for x in items]), np.cumsum([len(x.words) for x in items])
        number, start = windows.numbers(words), np.concatenate(([0], ends[:-1]))
        own = np.zeros(base.shape, np.float32)
        length, _ = windows.lengths(words, number, start, ends)
        image = windows.folded(number, start, ends, base) / np.maximum(length, 1e-9).astype(np.float32)[:, None]
        known = np.flatnonzero(number >= 0)
        words = number[known]
        np.add.at(own, words, image[np.searchsorted(ends, known, "right")] * windows.weight[words, None])
        weight = len(items) / 10 / max(1, n) / max(1e-9, float((windows.weight ** 2).mean()))
        return total * weight + own

    if not size:
        return np.zeros((0, 1), np.float32)
    start = np.random.default_rng(7).standard_normal((size, rank)).astype(np.float32)
    basis = np.linalg.qr(summed(start))[0].astype(np.float32)
    small = basis.T @ summed(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (basis @ turn[:, np.argsort(values)[::-1][:RANK]]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit operations on whole rows."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def settle(item: Item, region: list[int]) -> tuple[float, float] | None:
    """Shares of the item's words in common order and of its answer in ``region``, if they make it a leak."""
    words = item.words.tolist()
    m = len(words)
    if m < MIN_ITEM:
        found = any(region[i:i + m] == words for i in range(len(region) - m + 1))
        return (1.0, 1.0) if found else None
    have = set(region)
    if sum(w in have for w in words) < REWORDED * m:
        return None
    share = common_subsequence(words, region) / m
    answer = len(item.answer & have) / len(item.answer)
    if share >= VERBATIM:
        return share, answer
    content = [w for w in words if w in item.content]
    if share < REWORDED or answer < ANSWER:
        return None
    if common_subsequence(content, [w for w in region if w in item.content]) < REWORDED * len(content):
        return None
    return share, answer


class Detector:
    """All item blocks with their latent spaces; finds the leaks in a column of texts."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        n, idf = document_weights(docs)
        # the benchmark is the stated query set; it is read in blocks
        items = read_items((r.asDict() for r in benchmark.toLocalIterator()), idf, common_idf(n))
        self.plain = [x for x in items if len(x.words) < MIN_ITEM]
        items = [p for x in items if len(x.words) >= MIN_ITEM for p in passages(x)]
        self.blocks = []
        blocks = -(-len(items) // BLOCK_ITEMS)
        for block in (items[i::blocks] for i in range(blocks)):
            windows = Windows(block, idf)
            space = latent_space(block, windows, docs)
            ends = np.cumsum([len(x.words) for x in block])
            number = windows.numbers(np.concatenate([x.words for x in block]))
            start = np.concatenate(([0], ends[:-1]))
            vectors = windows.folded(number, start, ends, space)
            length, _ = windows.lengths(np.concatenate([x.words for x in block]), number, start, ends)
            size = np.sqrt(length).astype(np.float32)
            vectors = vectors / size[:, None]
            # what a word of a window adds to the product with a passage, and to its part of the passage, at most
            adds = (space * windows.weight[:, None]).astype(np.float64) @ vectors.T
            most = adds.max(axis=1), (adds / size).max(axis=1)
            self.blocks.append((block, windows, space, vectors, size, most))

    def find(self, texts: pa.Array) -> Iterator[tuple[int, object, float, float, float]]:
        """Row, item_id, shares and cosine of each leak in ``texts``."""
        base = 0
        for part in _slices(texts):
            h, rows = hashed_words(part, alnum=True)
            best: dict[tuple[int, object], tuple[float, float, float]] = {}
            for block, windows, space, vectors, size, most in self.blocks:
                number = windows.numbers(h)
                row, start, end = windows.bounds(rows)
                length, own = windows.lengths(h, number, start, end)
                # no cosine exceeds the share of the vocabulary in the length of the window
                # and no part of an item exceeds that share in the item's length
                least = np.minimum(MIN_COSINE ** 2 * length, MIN_PART ** 2 * size.min() ** 2)
                # and neither exceeds the sum of what the window's words add to the passage they add most to
                dot, part_of = (windows.summed(number, start, end, x) for x in most)
                reach = (dot >= (1 - SLACK) * MIN_COSINE * np.sqrt(length)) | (part_of >= (1 - SLACK) * MIN_PART)
                k = np.flatnonzero((own >= least) & (own > 0) & reach)
                row, start, end, length = row[k], start[k], end[k], length[k]
                dot = windows.folded(number, start, end, space) @ vectors.T
                cosine = dot / np.sqrt(length)[:, None]
                settled: dict[tuple[int, int], tuple[float, float] | None] = {}
                for w, i in zip(*np.nonzero((cosine >= MIN_COSINE) | (dot >= MIN_PART * size))):
                    item, m = block[i].item, len(block[i].item.words)
                    low, high = rows[row[w]], rows[row[w] + 1]
                    if (w, id(item)) not in settled:    # once for all passages of the item
                        settled[w, id(item)] = settle(item, h[max(low, start[w] - m):min(high, end[w] + m)].tolist())
                    verdict = settled[w, id(item)]
                    if verdict:
                        key = (int(row[w]), item.item_id)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (*verdict, min(1.0, float(cosine[w, i]))))
            for item in self.plain:
                for at in np.flatnonzero(h[:len(h) - len(item.words) + 1] == item.words[0]):
                    row = int(np.searchsorted(rows, at, "right")) - 1
                    end = at + len(item.words)
                    if end <= rows[row + 1] and (h[at:end] == item.words).all():
                        best[(row, item.item_id)] = (1.0, 1.0, 1.0)
            for (r, i), v in best.items():
                yield base + r, i, *v
            base += len(part)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, lcs_share, answer_share, cosine``: one row per document and item found in it.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text`` and may have ``answer``. Null and empty
    texts contain nothing, items without words are found nowhere, items of equal text are all found, and
    repeated rows give repeated results. Texts of any length are searched whole. Empty tables give an empty result. The cosine is that of the item's nearest
    passage; it takes the squared length
    of a window as the sum over its words, so that repeated words can only raise it.
    """
    docs = docs.select("doc_id", "text")
    detector = Detector(docs, benchmark)
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType)
    for name in ("lcs_share", "answer_share", "cosine"):
        schema = schema.add(name, "double")
    item_type = pa.string() if benchmark.schema["item_id"].dataType.typeName() == "string" else pa.int64()

    def run(batches):
        for batch in batches:
            rows = list(detector.find(batch.column(1)))
            at, item, *values = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type),
                 *[pa.array(v, pa.float64()) for v in values]], schema.names)
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    detector = Detector(docs.select("doc_id", "text"), benchmark)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in detector.find(batch.column(at))]] = False
            yield batch.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)
