"""Exact similarity classes of documents by the Jaccard coefficient of their word shingles.

Rare-first prefix filtering: if two sets are similar enough, their first common shingle in any fixed order lies
in a short prefix of both. With rare shingles first, prefixes meet seldom by chance. Candidates pass length,
positional and suffix filters and are verified once per pair on the whole sets.

Large groups of near copies never expand to all pairs. First every document is linked to one pivot per prefix
shingle and class of sizes: the one with the fewest rarer shingles before it, which is the least changed copy. What
these links join needs no further look; then all remaining candidate pairs *between* components are verified, so the
components are those of the full link graph.

Shingles are 64-bit hashes, distinct sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.components import components, with_links
from doclake.llm.texts import hashed_words, mixed
from doclake.sources.scratch import freeze, stored

WIDTH = 5
COUNT_BITS = 18      # size of the table of shingle frequencies: 2^18 counters, 1 MB for every task
SEEN_BITS = 23       # size of the bitmap of documents that have candidates: 1 MB for every task
RANGE_BITS = (6, 16)  # the suffix filter splits a set into 2^6 to 2^16 ranges of hash values, 4 to 8 shingles in each
STAR_ORDERS = 16     # pivots of the second star


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles: one for a short text, none without words."""
    h, bounds = hashed_words(texts)
    g = np.full(max(0, len(h) - WIDTH + 1), WIDTH, np.uint64)
    for k in range(WIDTH):
        g = mixed(g) + h[k:k + len(g)]
    g = mixed(g)
    for start, end in zip(bounds[:-1], bounds[1:]):
        n = end - start
        if n >= WIDTH:
            own = np.sort(g[start:end - WIDTH + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            one = np.full(1, n, np.uint64)
            for k in range(start, end):
                one = mixed(one) + h[k]
            yield mixed(one)
        else:
            yield h[:0]


def _in_arrow(frame: DataFrame, make, schema: str) -> DataFrame:
    """Run ``make(ids, texts) -> columns`` on each Arrow batch of ``doc_id, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch.column(0), batch.column(1))
    return frame.mapInArrow(run, schema)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Document frequency of shingles by the top bits of their hash, an upper bound for each shingle.

    The counts cover all documents and have a fixed size whatever the corpus is. What matters is that
    shingles of common passages stand out from the mean and go last; ties are ordered by hash.
    """
    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for g in shingle_sets(batch.column(1)):
                np.add.at(total, (g >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = docs.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def probe_length(n, tenths):
    """Prefix of the larger set: n - ceil(t n) + 1."""
    return n - (tenths * n + 9) // 10 + 1


def index_length(n: Column, tenths: int) -> Column:
    """Prefix of the smaller set: n - ceil(2t / (1 + t) n) + 1."""
    return n - F.ceil(2 * tenths * n / F.lit(10 + tenths)) + 1


def profile(g: np.ndarray) -> np.ndarray:
    """Number of shingles in each range of hash values: the longer the set, the finer the ranges.

    With ranges of a fixed number, any two long sets look alike.
    """
    bits = min(max(len(g).bit_length() - 3, RANGE_BITS[0]), RANGE_BITS[1])
    counts = np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, np.iinfo(np.int16).max).astype(np.int16)


def prefixes(docs: DataFrame, counts: np.ndarray, tenths: int) -> DataFrame:
    """Per row: doc_id, n (set size), sig (128 bits of the set), its prefix in rare-first order, its profile."""
    ranks = np.minimum(counts, (1 << 30) - 1).astype(np.uint64) << np.uint64(34)

    def make(ids, texts):
        n, sig, flat, ends, ranges = [], [], [], [0], []
        for g in shingle_sets(texts):
            keys = ranks[(g >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] | (mixed(g) >> np.uint64(30))
            p = probe_length(len(g), tenths) if len(g) else 0
            flat.append(g[np.argsort(keys, kind="stable")[:p]])     # equal keys stay in the order of the hash
            ends.append(ends[-1] + p)
            n.append(len(g))
            sig.append(xxhash.xxh3_128_digest(g.tobytes()))
            ranges.append(profile(g))
        values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        cuts = np.cumsum([0, *map(len, ranges)])
        counts = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int16), *ranges])))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(sig, pa.binary()), lists, counts],
                                         ["doc_id", "n", "sig", "prefix", "profile"])

    return _in_arrow(docs, make, "doc_id long, n int, sig binary, prefix array<long>, profile array<short>")


def whole_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``sig, grams`` of the sets whose bit is in ``wanted``; a few others may come along."""
    def make(ids, texts):
        sig, flat, ends = {}, [], [0]
        for g in shingle_sets(texts):
            s = xxhash.xxh3_128_digest(g.tobytes())
            bit = xxhash.xxh3_64_intdigest(s) >> (64 - SEEN_BITS)
            if s not in sig and wanted[bit >> 3] >> (bit & 7) & 1:
                sig[s] = None
                flat.append(g)
                ends.append(ends[-1] + len(g))
        values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sig), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
            ["sig", "grams"])
    return _in_arrow(docs, make, "sig binary, grams array<long>")


def _bits(nodes: DataFrame) -> np.ndarray:
    """Bitmap of ``nodes`` (``sig``): at most 2^SEEN_BITS bits reach the driver, whatever the number of nodes is."""
    def mark(batches):
        bits = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
        for batch in batches:
            for s in batch.column(0):
                bit = xxhash.xxh3_64_intdigest(s.as_py()) >> (64 - SEEN_BITS)
                bits[bit >> 3] |= 1 << (bit & 7)
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].astype(np.int32))],
                                         ["at", "bits"])
    rows = nodes.mapInArrow(mark, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return out


def _halved(counts: Column) -> Column:
    """The profile of ranges twice as wide."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(counts) / 2).cast("int") - 1),
                       lambda i: (F.get(counts, 2 * i) + F.get(counts, 2 * i + 1)).cast("short"))


def _plausible(pairs: DataFrame, shape: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) that pass the length filter and the suffix filter, with their set sizes.

    Similar sets share at least t / (1 + t) (n_a + n_b) elements, and no range of hash values adds more to
    the overlap than the smaller of its two counts.
    """
    def side(name):
        return shape.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                            F.col("profile").alias(f"profile_{name}"))

    def even(name, other):      # halved until it is as short as the other one
        x, size = F.col(f"profile_{name}"), F.size(f"profile_{other}")
        halves = F.floor(F.log2(F.size(x) / size)).cast("int")
        return F.when(halves > 0, F.aggregate(F.sequence(F.lit(1), halves), x, lambda s, _: _halved(s))).otherwise(x)
    most = F.aggregate(F.zip_with(even("a", "b"), even("b", "a"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .filter(10 * F.least("n_a", "n_b") >= tenths * F.greatest("n_a", "n_b"))
            .filter((10 + tenths) * most >= tenths * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b"))


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    """The pairs whose whole sets are similar. The sets are read from the texts of the documents that have a pair.

    The set of b travels to a, the hub of a star: sets are shuffled once by what they are and once by the hub.
    """
    if pairs.limit(1).count() == 0:
        return pairs.select("a", "b")
    return stored(docs.sparkSession, "links", lambda: _similar(docs, pairs, nodes, tenths))


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    sent = (pairs.select("a", F.col("b").alias("node"), "n_a", "n_b")
            .union(pairs.select("a", F.col("a").alias("node"), "n_a", F.lit(None)).distinct()))
    wanted = freeze(sent.join(nodes.select("node", "sig"), "node"), "wanted")
    grams = whole_sets(docs, _bits(wanted.select("sig"))).groupBy("sig").agg(F.first("grams").alias("grams"))
    sets = freeze(wanted.join(grams, "sig").drop("sig"), "sets")
    hubs = sets.filter("n_b IS NULL").select("a", F.col("grams").alias("grams_a"))
    pairs = sets.filter("n_b IS NOT NULL").select("a", F.col("node").alias("b"), "n_a", "n_b", "grams").join(hubs, "a")
    overlap = F.size(F.array_intersect("grams_a", "grams"))
    return pairs.filter((10 + tenths) * overlap >= tenths * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _size_class(n: Column, tenths: int, shift: float) -> Column:
    """Sizes of a class differ by less than the threshold; a shift of 0.5 moves the borders to the middle."""
    return F.floor(F.log(n) / F.log(F.lit(10 / tenths)) + shift)


def _stars(places: DataFrame, order: Column, shift: float, tenths: int) -> DataFrame:
    """``a, b``: one pair for each place and the first place, by ``order``, of its token and size class.

    Pairs whose sizes or positions rule out similarity are left out, as are those of one component.
    """
    places = places.withColumn("class", _size_class(F.col("n"), tenths, shift))
    pivot = F.min_by(F.struct("node", "n", "pos", "comp"), order)
    pivots = (places.groupBy("token", "class").agg(pivot.alias("p"), F.count(F.lit(1)).alias("_many"))
              .filter("_many > 1").drop("_many"))
    met = places.join(pivots, ["token", "class"]).filter("comp != p.comp")
    return (met.filter(_may_reach(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), tenths))
            .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct())


def _may_reach(n_x: Column, pos_x: Column, n_y: Column, pos_y: Column, tenths: int) -> Column:
    """Length and positional filter of two sets whose first common token is at these positions."""
    rest = 1 + F.least(n_x - pos_x - 1, n_y - pos_y - 1)
    return ((10 * F.least(n_x, n_y) >= tenths * F.greatest(n_x, n_y))
            & ((10 + tenths) * rest >= tenths * (n_x + n_y)))


def _unpacked(places: DataFrame) -> DataFrame:
    return places.withColumns({"pos": F.shiftright("place", 32).cast("int"),
                               "n": F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")}).drop("place")


def _open_places(meets: DataFrame, comps: DataFrame) -> DataFrame:
    """``token, node, place, comp`` of the shingles whose documents are not all in one component."""
    placed = meets.join(comps, "node", "left").select("token", "node", "place", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    return freeze(placed.join(mixed.select("token"), "token", "left_semi"), "open")


def similarity_classes(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``, any others).

    ``tenths`` is the threshold times ten. Texts without words (null, empty, blank) have 0 shingles and are
    linked with nothing. Repeated rows and equal sets are in one class. Rows without ``doc_id`` take part, but a
    class is named by the smallest id it has, null if it has none. An empty table gives an empty result. What is
    stored on the way is removed at the end.
    """
    return stored(docs.sparkSession, "classes", lambda: _classes(docs.select("doc_id", "text"), tenths))


def _classes(docs: DataFrame, tenths: int) -> DataFrame:
    rows = freeze(prefixes(docs, frequencies(docs), tenths).withColumn("row_no", F.monotonically_increasing_id()),
                  "prefixes")
    nodes = (rows.filter("n > 0").groupBy("sig").agg(F.min("row_no").alias("row_no"), F.min("doc_id").alias("least")))
    nodes = freeze(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    numbered = rows.join(nodes.select("row_no", "node"), "row_no")
    shape = freeze(numbered.select("node", "n", "profile"), "shape")

    # place packs position and set size, which keeps the shuffled rows short
    places = numbered.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "node", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("place"))
    shared = places.groupBy("token").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    meets = freeze(places.join(shared, "token", "left_semi"), "meets")

    # the first pivots have the fewest rarer shingles, so the fewest changes
    alone = _unpacked(meets).withColumn("comp", F.col("node"))
    likely = freeze(_plausible(_stars(alone, F.struct("pos", "node"), 0.0, tenths), shape, tenths), "star_pairs")
    comps = components(_verified(docs, likely, nodes, tenths))
    tried = likely.select("a", "b")

    # A second star with other classes and other pivots, by one of some orders for each shingle, joins what is not
    # similar to the first pivot: each document meets up to STAR_ORDERS of them.
    order = F.xxhash64(F.pmod("token", F.lit(STAR_ORDERS)), "node")
    again = _stars(_unpacked(_open_places(meets, comps)), order, 0.5, tenths)
    likely = freeze(_plausible(again.join(tried, ["a", "b"], "left_anti"), shape, tenths), "star_pairs")
    comps = with_links(comps, _verified(docs, likely, nodes, tenths))
    tried = tried.union(likely.select("a", "b"))

    # All candidate pairs between different components: one side is always outside the token's largest component.
    open_ = _open_places(meets, comps)
    major = (open_.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", "count").alias("major")))
    sided = _unpacked(open_.join(major, "token"))
    x, y = sided.filter("comp != major").alias("x"), sided.alias("y")
    n_x, n_y, pos_x, pos_y = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos"))
    x_larger = (n_x > n_y) | ((n_x == n_y) & (F.col("x.node") > F.col("y.node")))
    indexed = F.when(x_larger, pos_y < index_length(n_y, tenths)).otherwise(pos_x < index_length(n_x, tenths))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
                   & _may_reach(n_x, pos_x, n_y, pos_y, tenths) & indexed)
    pairs = (pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
             .join(tried, ["a", "b"], "left_anti"))
    likely = freeze(_plausible(pairs, shape, tenths), "cross_pairs")
    whole = with_links(comps, _verified(docs, likely, nodes, tenths))

    named = nodes.join(whole, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "comp").select("sig", "component_id")
    return (rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig")
            .join(ids, "sig", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def keep_one(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """The rows of ``docs`` without all but one document, that with the smallest id, of each class.

    Rows that repeat id and text count as one document. Rows without words or without id stay.
    """
    first = similarity_classes(docs, tenths).filter("doc_id = component_id").select("doc_id").distinct()
    unnamed = docs.filter(F.col("doc_id").isNull())
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(unnamed)
