"""Byte-level BPE with the ranks of a public vocabulary, as a tree reduction over the bytes of a word.

Encodings of neighbouring byte strings form a monoid: a word is halved down to single bytes, and two encoded
halves are joined by encoding a window around their border anew. The window grows until its first and last token
both stay apart from the tokens outside. Then everything outside is final:

    Merging picks the pair of the lowest rank, the leftmost of equal ones. Take tokens t1 ... tn of which each
    neighbouring pair, merged from its bytes, ends as that pair. Before the first merge across any border, the
    merges within ti and ti+1 are those of the pair alone, in the same order. So that first merge would happen in
    the pair alone too, which it does not. Hence no merge crosses a border, and t1 ... tn is the encoding.

This holds for every table of ranks. Decoding concatenates the bytes of tokens up a tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

KNOWN_WORDS = 250_000       # words, halves and pairs that a task remembers
KNOWN_HALVES = 150_000
KNOWN_PAIRS = 150_000
SHARED = 6                  # bytes of a half that is remembered
SHORT = 48                  # bytes up to which a plain search for the best pair is quick
NEVER = 1 << 62             # rank of what is no piece
MATCHES = 100_000           # words of a long text that are handled together


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def word_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@cache
def late_characters(kind: str) -> str:
    """Ranges, as in a character class, of what ``regex`` counts as ``\\p{kind}`` and the pattern engine of the tokenizer library doesn't yet.

    The two know different versions of Unicode. Worked out once, on the driver.
    """
    import regex
    import tiktoken
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ours = set(regex.findall(rf"\p{{{kind}}}", every))
    plain = tiktoken.Encoding("bytes", pat_str=rf"\p{{{kind}}}+", special_tokens={},
                              mergeable_ranks={bytes([b]): b for b in range(256)})
    late = sorted(map(ord, ours - set(bytes(plain.encode_ordinary(every)).decode())))
    starts = [c for c, before in zip(late, [None, *late]) if before != c - 1]
    ends = [c for c, after in zip(late, [*late[1:], None]) if after != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Words:
    """Cuts a text into the words of a pattern, the way the tokenizer library does."""

    def __init__(self, pattern: str, late: dict[str, str]):
        import regex
        self.plain = regex.compile(pattern)
        self.exact, self.late = self.plain, None
        if any(late.values()):
            for kind, ranges in late.items():
                if ranges:
                    pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{ranges}]]")
            self.exact = regex.compile(pattern, regex.V1)
            self.late = re.compile("[" + "".join(late.values()) + "]")

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words in order, in bounded lists."""
        pattern = self.exact if self.late and not text.isascii() and self.late.search(text) else self.plain
        if len(text) <= MATCHES:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, MATCHES)):
            yield part


class BytePairs:
    """Ranks of a vocabulary file and the encoding of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.raw = {rank: piece for piece, rank in self.ranks.items()}
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered; called where a task ends."""
        self.words: dict[str, bytes] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int] | None] = {}

    def merged(self, word: bytes) -> list[int]:
        """Encoding of a window: the pair of the lowest rank is merged until no pair has a rank."""
        return self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        rank, parts = self.ranks.get, [word[i:i + 1] for i in range(len(word))]
        found = [rank(word[i:i + 2], NEVER) for i in range(len(word) - 1)]
        while found and (best := min(found)) != NEVER:
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(found):
                found[i] = rank(parts[i] + parts[i + 1], NEVER)
        return [rank(p) for p in parts]

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list of parts."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))             # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n))             # where the part before starts

        def rank(at: int) -> int:
            return ranks.get(word[at:end[end[at]]], NEVER) if end[at] < n else NEVER
        heap = [(r, at, end[end[at]]) for at in range(n - 1) if (r := rank(at)) != NEVER]
        heapify(heap)
        while heap:
            _, at, reach = heappop(heap)
            if not end[at] or end[at] >= n or end[end[at]] != reach:
                continue                        # one of the two parts is another by now
            gone = end[at]
            end[at], end[gone] = reach, 0
            before[reach] = at
            for start in (before[at], at):
                if start >= 0 and (r := rank(start)) != NEVER:
                    heappush(heap, (r, start, end[end[start]]))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at:end[at]]])
            at = end[at]
        return out

    def pair(self, left: int, right: int) -> list[int] | None:
        """What two neighbouring tokens become when they are merged from their bytes; None: they stay apart."""
        key = left, right
        if key not in self.pairs:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            ids = self.merged(self.raw[left] + self.raw[right])
            self.pairs[key] = None if ids == [left, right] else ids
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring byte strings, from that of each."""
        window, at, to = self.pair(left[-1], right[0]), len(left) - 1, 1
        if window is None:
            return left + right
        while True:
            before = at > 0 and self.pair(left[at - 1], window[0]) is not None
            after = to < len(right) and self.pair(window[-1], right[to]) is not None
            if not before and not after:
                return left[:at] + window + right[to:]
            if before:
                at = max(0, 2 * at - len(left))
            if after:
                to = min(len(right), 2 * to)
            window = self.merged(b"".join(map(self.raw.__getitem__, left[at:] + right[:to])))

    def reduced(self, word: bytes) -> list[int]:
        """Encode both halves and join them; short halves, which many words share, are remembered."""
        ids = self.halves.get(word)
        if ids is None:
            middle = len(word) // 2
            ids = self.join(self.reduced(word[:middle]), self.reduced(word[middle:])) if middle else [self.ranks[word]]
            if len(word) <= SHARED:
                if len(self.halves) >= KNOWN_HALVES:
                    self.halves.clear()
                self.halves[word] = ids
        return ids

    def word(self, word: bytes) -> list[int]:
        """Ids of a word; one that is in the vocabulary is one token, however it merges."""
        whole = self.ranks.get(word)
        return self.reduced(word) if whole is None else [whole]

    def encode(self, parts: Iterable[list[str]]) -> bytes:
        """Ids of the words of a text as 32-bit integers."""
        out = []
        for part in parts:
            new = set(part).difference(self.words)
            for w in new:
                self.words[w] = array("i", self.word(w.encode())).tobytes()
            out.append(b"".join(map(self.words.__getitem__, part)))
            if len(self.words) > KNOWN_WORDS:       # full: what came first, with the common words, stays
                for w in new:
                    del self.words[w]
        return out[0] if len(out) == 1 else b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of both halves, one after the other."""
        if len(ids) <= 2048:
            return b"".join(map(self.raw.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_loaded: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The vocabulary of a file, once per worker process."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (``doc_id``) of ``docs``, with ``ids array<int>`` of ``text``.

    Null and empty texts have no ids. A text of any length is encoded whole; its words are handled in bounded
    lists. Every row is encoded by itself, so repeated rows have equal ids; other columns of ``docs`` play no
    part. An empty table gives an empty result.
    """
    path, pattern, carry = path or vocabulary_path(), pattern or word_pattern(), carry or ["doc_id"]
    late = {kind: late_characters(kind) for kind in ("L", "N")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = load(path), Words(pattern, late)
        try:
            for batch in batches:
                raw = [model.encode(words.cut(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids.cast(pa.list_(pa.int32()))], [*carry, "ids"])
        finally:
            model.forget()
    frame = docs.select(*[docs[f"`{c}`"] for c in carry], docs["text"].alias("_text"))
    return frame.mapInArrow(run, frame.select(*carry).schema.add("ids", ArrayType(IntegerType())))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, bytes`` of ``doc_id, ids``; null and no ids give no bytes."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            raw = [model.decode(x.values.to_pylist()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])
    frame = rows.select("doc_id", "ids")
    return frame.mapInArrow(run, frame.select("doc_id").schema.add("bytes", "binary"))


def digests(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows (``doc_id, ids``).

    The digests are those of the ids as little-endian unsigned 32-bit integers and of the decoded bytes.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = []
            for x in batch.column(1):
                ids = x.values.to_numpy()
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                            hashlib.sha256(model.decode(ids.tolist())).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.string()])]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    frame = rows.select("doc_id", "ids")
    return frame.mapInArrow(run, frame.select("doc_id").schema.add("n_tokens", "long")
                            .add("ids_sha256", "string").add("decoded_sha256", "string"))
