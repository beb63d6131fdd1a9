"""Token ids as flat binary files that a trainer memory-maps.

A shard is two files: ``<name>.bin`` holds the ids of its documents one after another, as the smallest unsigned
little-endian integers that hold the vocabulary; ``<name>.idx`` holds 64-bit integers: the number of documents
n, their n ids, n flags (1: the id is null), and n + 1 offsets, in tokens from the start of the shard. Documents
stand in ascending order of their id over all shards; the base of a shard is the sum of the tokens before it.

A task writes under a name of its own attempt and hands back that name, so the manifest lists each shard once
however often tasks run; files that it does not list are left-overs.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze

SHARD_BYTES = 64 << 20     # text that goes to one shard
CACHED_WORDS = 800_000     # that a worker remembers from task to task
SLICE = 1 << 22            # characters that are encoded together
#: From 65,536 ids on, they take four bytes.
WIDE = 1 << 16


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """A byte-level tokenizer that meets each distinct word once.

    A blank between two other characters starts a pre-token, and a line end between two characters that are no white
    space is one. So a text can be cut before each blank and each line end, as long as neither stands beside other
    white space; texts where one does, and texts with special tokens, go to the tokenizer as a whole. Distinct words
    are encoded together: the piece that starts with the blank, or the line end, shows where each begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4" if self.size > WIDE else "<u2")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = {" ": np.zeros(self.size, bool), "\n": np.zeros(self.size, bool)}
        for piece, i in self.tokenizer.get_vocab().items():
            self.opens[" "][i] = piece.startswith(blank)
        self.opens["\n"][self._ids("\n")] = True
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes | None] = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, text: str) -> bytes:
        return np.array(self._ids(text) if text else [], self.dtype).tobytes()

    def _learn(self, start: str, words: list[str]) -> dict[str, bytes | None]:
        """Ids of words that follow ``start``; None for one that has white space at an end."""
        out: dict[str, bytes | None] = {}
        plain = [w for w in words if w.split() == [w]]
        ids = np.array(self.tokenizer.encode_batch_fast([start + start.join(plain)], add_special_tokens=False)[0].ids
                       if plain else [], self.dtype)
        at = np.flatnonzero(self.opens[start][ids])
        mark = start.strip(" ")
        if len(at) == len(plain):
            raw, width = ids.tobytes(), self.dtype.itemsize
            ends = np.append(at[1:], len(ids)) * width
            out.update((mark + w, raw[s:e]) for w, s, e in zip(plain, (at * width).tolist(), ends.tolist()))
        else:       # a word holds a piece that looks like a start
            out.update((mark + w, self._packed(start + w)) for w in plain)
        if len(plain) < len(words):
            for w in words:
                if mark + w not in out:
                    out[mark + w] = None if w[:1].isspace() or w[-1:].isspace() else self._packed(start + w)
        return out

    def _cut(self, text: str | None) -> list[str] | None:
        """Words without their blank, but with a line end before them; None for a text that has to stay whole."""
        if text is None or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] == " " or self.special.search(text):
            return None
        words = text.replace("\n", " \n").split(" ")
        return None if len(words) > 1 and words[0][-1:].isspace() else words

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed integers; none for null."""
        cut = [self._cut(t) for t in texts]
        # the first word has no blank before it
        first = [c and c[0] for c in cut]
        for c in filter(None, cut):
            c[0] = ""
        met = set().union(*filter(None, cut))
        new = met.difference(self.words)
        learned = {}
        if new:
            learned = self._learn(" ", [w for w in new if w[:1] != "\n"]) | self._learn("\n", [w[1:] for w in new if w[:1] == "\n"])
        # each text looks its words up in the few of this slice: the table of the worker is large, and slow to walk
        met -= new
        here = dict(zip(met, map(self.words.__getitem__, met))) | learned
        out = []
        for t, c, f in zip(texts, cut, first):
            parts = [None] if c is None else list(map(here.__getitem__, c))
            out.append(self._packed(t or "") if None in parts else self._packed(f) + b"".join(parts))
        if len(self.words) + len(learned) <= CACHED_WORDS:      # else full: what came first, with the common words, stays
            self.words.update(learned)
        return out


_loaded: dict[str, WordEncoder] = {}


def load(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_shards(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None,
                 shards: int | None = None) -> DataFrame:
    """Write ``doc_id, text`` of ``docs`` to ``folder`` and return the stored manifest.

    Manifest: ``shard, name, n_docs, n_tokens, base``. Every document ends with ``end_id``; null and empty texts
    have that id alone. Null ids come first; rows of equal id are ordered by the hash of their text, so a
    repeated id spreads over shards. Texts of any length are encoded whole; other columns of ``docs`` play no part. An empty table has an empty manifest.
    """
    path = path or tokenizer_path()
    docs = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    frame = (docs.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "_tie")
             .sortWithinPartitions(F.asc_nulls_first("doc_id"), "_tie")
             .select("doc_id", "text").withColumn("shard", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        end = np.array([end_id], model.dtype).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, ids, flags, offsets, shard, out = f"shard-{uuid.uuid4().hex}", [], [], [0], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out, shard = fs.open_output_stream(f"{root}/{name}.bin"), batch.column(2)[0].as_py()
            ids += [x or 0 for x in batch.column(0).to_pylist()]
            flags += [int(not x.is_valid) for x in batch.column(0)]
            texts, size = [], 0
            for t in [*batch.column(1), None]:
                if t is not None:
                    texts.append(t.as_py())
                    size += len(texts[-1] or "")
                if t is None or size >= SLICE:
                    for raw in model.encode(texts):
                        out.write(raw)
                        out.write(end)
                        offsets.append(offsets[-1] + len(raw) // model.dtype.itemsize + 1)
                    texts, size = [], 0
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array([len(ids), *ids, *flags, *offsets], "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name],
                                              "n_docs": [len(ids)], "n_tokens": [offsets[-1]]})

    rows = freeze(frame.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long"), "shards")
    # one row per shard: the running sum is small however large the files are
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return freeze(rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def _read(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes: mapped where the file system is a mounted one, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_documents(manifest: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from the files; ``start`` counts over all shards."""
    path = path or tokenizer_path()

    def run(batches):
        dtype = load(path).dtype
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = np.frombuffer(_read(fs, f"{root}/{name}.idx"), "<i8")
                n = int(index[0])
                ids, null, offsets = index[1:n + 1], index[n + 1:2 * n + 1] == 1, index[2 * n + 1:]
                tokens = np.frombuffer(_read(fs, f"{root}/{name}.bin"), dtype)
                crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=null), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    shards = manifest.select("name", "base").repartition("name")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
