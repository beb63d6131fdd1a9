"""Merkle manifest of a dataset: one tree of rows per group, one tree over the roots of the groups.

Every level of all trees is one table of nodes: ``tree``, ``idx`` (place among the nodes of the level), ``digest``.
A node computes the places of its siblings, by XOR where runs hold two nodes, by offsets from its slot otherwise,
and an equijoin of the level with itself on (tree, place) fetches their digests. The nodes in slot zero, which then
know their whole run, emit the parents. Only they need to ask: the run is stored with the parent, once and not once
per node, and proofs read the siblings of every other node from there.

Keys are single places, so a group that holds a third of all rows spreads like any other; rows get their places
through range partitions. Levels are stored as they are made, each a ``width``-th of the one below. A tree is
finished where its node 0 has no sibling: places have no gaps, so such a node is alone on its level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.operators.skew import running_total
from doclake.sources.scratch import freeze

WIDTH = 16
SIZE = 32       # bytes of a digest
ROWS_PER_RANGE = 20_000


def digest(data: Column) -> Column:
    """sha256 as bytes."""
    return F.unhex(F.sha2(data, 256))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def joined(digests: Column) -> Column:
    """The bytes of an array of digests one after another."""
    return F.aggregate(digests, F.lit(b""), lambda all_, d: F.concat(all_, d))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: ``-`` for a null field, else its length in UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]))


def sibling_places(idx: Column, width: int) -> Column:
    """Places of the other nodes of the run, as far as the level reaches."""
    if width == 2:
        return F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    slot = idx % width
    return F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda k: idx - slot + (slot + k) % width)


def _runs(nodes: DataFrame, width: int) -> DataFrame:
    """``tree, place, run`` of each run of a level: the place of the parent, the digests in order."""
    first = nodes.filter(F.col("idx") % width == 0)
    wanted = first.select("tree", "idx", F.explode(sibling_places(F.col("idx"), width)).alias("_place"))
    there = (nodes.filter(F.col("idx") % width != 0)
             .select("tree", F.col("idx").alias("_place"), F.col("digest").alias("_digest")))
    others = (wanted.join(there, ["tree", "_place"]).groupBy("tree", "idx")
              .agg(F.array_sort(F.collect_list(F.struct("_place", "_digest"))).alias("_others")))
    rest = joined(F.transform("_others", lambda s: s["_digest"]))
    return first.join(others, ["tree", "idx"], "left").select(
        "tree", F.expr(f"idx div {width}").alias("place"), F.concat("digest", F.coalesce(rest, F.lit(b""))).alias("run"))


def _alone() -> Column:
    """The run of a finished tree is its root alone. (Runs of one node occur at place 0 nowhere else.)"""
    return (F.col("place") == 0) & (F.octet_length("run") == SIZE)


def _parents(runs: DataFrame) -> DataFrame:
    return runs.filter(~_alone()).select("tree", F.col("place").alias("idx"), digest(hexed(F.col("run"))).alias("digest"), "run")


def build(nodes: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """The stored runs ``tree, place, run`` of each level, the lowest first, from ``nodes`` (``tree, idx, digest``)."""
    top = nodes.agg(F.max("idx")).first()[0]
    levels = []
    while top is not None:
        levels.append(freeze(_runs(nodes, width), f"level{len(levels)}"))
        nodes = _parents(levels[-1])
        top = top // width if top else None
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the finished trees."""
    found = [runs.filter(_alone()).select("tree", F.col("run").alias("digest")) for runs in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, width: int = WIDTH) -> DataFrame:
    """The lowest nodes with ``path array<struct<slot, run>>``, from their own run upwards.

    ``above`` holds, per tree, the path that follows its root, and further columns that are handed down.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for n, runs in reversed(list(enumerate(levels))):
        over = (runs.filter(_alone()).select("tree", F.col("place").alias("_up"), F.lit(None).cast("binary").alias("_run"))
                .join(above.withColumnRenamed("path", "_rest"), "tree"))
        if parents is not None:
            over = over.unionByName(parents.select("tree", F.col("idx").alias("_up"), F.col("run").alias("_run"),
                                                   F.col("path").alias("_rest"), *handed))
        level = nodes if n == 0 else _parents(levels[n - 1])
        step = F.array(F.struct((F.col("idx") % width).cast("int").alias("slot"), F.col("_run").alias("run")))
        parents = (level.withColumn("_up", F.expr(f"idx div {width}")).join(over, ["tree", "_up"])
                   .withColumn("path", F.when(F.col("_run").isNull(), F.col("_rest")).otherwise(F.concat(step, "_rest")))
                   .drop("_up", "_run", "_rest"))
    return parents


def _before(step: Column) -> Column:
    return F.substring(step["run"], F.lit(1), step["slot"] * SIZE)


def _behind(step: Column) -> Column:
    return F.substring(step["run"], step["slot"] * SIZE + SIZE + 1, F.octet_length(step["run"]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, start, lambda acc, step: digest(hexed(F.concat(_before(step), acc, _behind(step)))))


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings of a path as hexadecimal text, from the leaf's run to the root's, left to right."""
    return F.sha2(hexed(joined(F.transform(path, lambda step: F.concat(_before(step), _behind(step))))), 256)


PATH = "array<struct<slot:int,run:binary>>"


@dataclass
class Manifest:
    """A stored tree.

    ``leaves`` holds the carried columns and ``tree, idx, digest``; ``order`` the subroots ``tree, digest`` with
    their place ``idx``; ``levels`` and ``top`` the runs below and above the subroots, the lowest first. ``tree``
    is empty for the null group, else ``=`` and the name of the group.
    """
    leaves: DataFrame
    levels: list[DataFrame]
    order: DataFrame
    top: list[DataFrame]
    width: int

    def root(self) -> DataFrame:
        """One row: ``digest`` of the dataset; none for an empty table."""
        return roots(self.top).select("digest") if self.top else self.order.select("digest")

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``path``: slot and run of each level up to the root."""
        if not self.levels:
            none = F.lit(None).cast("binary")
            return self.leaves.withColumns({"path": F.lit(None).cast(PATH), "subroot": none, "root": none})
        whole = roots(self.top).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
        subroots = self.order.select(F.lit("").alias("tree"), "idx", F.col("tree").alias("_group"), F.col("digest").alias("subroot"))
        groups = (with_paths(subroots, self.top, whole, self.width)
                  .select(F.col("_group").alias("tree"), "path", "subroot", "root"))
        return with_paths(self.leaves, self.levels, groups, self.width)


def manifest(docs: DataFrame, fields: list[str], key: str, group: str, carry: dict[str, Column] | None = None,
             width: int = WIDTH) -> Manifest:
    """Trees over all rows of ``docs``: a leaf covers ``fields``, groups come in order of ``group``, rows of ``key``.

    A null group is a group and comes first; null keys come first; rows of equal key are ordered by their leaf, so
    equal rows are interchangeable. Null and empty fields differ; texts of any length are hashed as they are. An
    empty table has no nodes. Only ``carry`` (columns of ``docs`` by names of their own) is stored with the leaves,
    so other columns cannot clash.
    """
    rows = docs.select(F.coalesce(F.concat(F.lit("="), docs[f"`{group}`"]), F.lit("")).alias("tree"),
                       docs[f"`{key}`"].alias("_key"), leaf([docs[f"`{f}`"] for f in fields]).alias("digest"),
                       *[c.alias(name) for name, c in (carry or {}).items()])
    places = running_total(freeze(rows, "leaves"), ["tree"], [F.col("_key"), F.col("digest")], F.lit(1), "idx",
                           ROWS_PER_RANGE)
    leaves = freeze(places.drop("_key"), "placed")
    levels = build(leaves.select("tree", "idx", "digest"), width)
    subroots = roots(levels) if levels else leaves.select("tree", "digest")
    order = freeze(running_total(subroots, [], [F.col("tree")], F.lit(1), "idx"), "subroots")
    return Manifest(leaves, levels, order, build(order.select(F.lit("").alias("tree"), "idx", "digest"), width), width)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents_manifest(docs: DataFrame, width: int = WIDTH) -> Manifest:
    """The manifest of ``documents`` by source and ``doc_id``, with the leaves of tampered rows as ``_start``.

    A row is tampered with where 5 divides the crc32 of its id: A-Z of its text become a-z. A null id has no crc32
    and is left alone, like null texts.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(hit, lower).otherwise(F.col("text"))
    start = leaf([*[F.col(f) for f in FIELDS[:-1]], text])
    return manifest(docs.select(*FIELDS), FIELDS, "doc_id", "source",
                    {"doc_id": F.col("doc_id"), "_start": F.when(hit, start)}, width)


def checked(tree: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of a documents' manifest."""
    rows = tree.proofs().withColumn("_folded", folded(F.coalesce("_start", "digest"), F.col("path")))
    return rows.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                       hexed(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                       hexed(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"))
