"""SentencePiece encoding and decoding with the vocabulary of a public model.

A text is cut into marked words (a blank becomes the mark that starts a word). The distinct words of a slice of
texts are sorted, which lays them out as a trie, and traversed depth first: the forward state of a prefix - the
piece that ends its best segmentation, and where that piece starts - is computed once for all words that begin
with it. A word's pieces are read backwards from its end.

The model's scores are merge ranks, not log-probabilities, so the best segmentation is the one in which no
merge of a higher score is left undone, not the one of the largest sum. It is unique, and so is the piece that
ends it at each prefix: the one that is stable beside the piece that ends the prefix before it. The results
equal those of the library.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

MARK = "▁"
SLICE = 1 << 21            # characters of text that are encoded together, which bounds the memory of a task
CACHED_WORDS = 400_000     # words and pairs that a worker remembers from task to task
CACHED_PAIRS = 200_000
LOWEST = float("-inf")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of a model file and the segmentation of marked words."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            elif sp.is_control(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece runs across the start of a word")
        self.reach: dict[str, int] = {}      # the longest piece that ends in these one or two characters
        for piece in self.ids:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.packed = {piece: array("i", [i]).tobytes() for piece, i in self.ids.items()}
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered."""
        self.stable: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short string by merging the pair of the highest score, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, LOWEST) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == LOWEST:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives ``piece``, twice itself for a character, None if merging ends elsewhere."""
        if piece not in self.split:
            parts, pair = list(piece), (piece, piece)
            while len(parts) > 1:
                scores = [self.score.get(a + b, LOWEST) for a, b in zip(parts, parts[1:])]
                best = max(scores)
                if best == LOWEST:
                    break
                i = scores.index(best)
                pair = (parts[i], parts[i + 1])
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.split[piece] = pair if len(parts) == 1 else None
        return self.split[piece]

    def _rank(self, piece: str) -> float:
        """Merges happen in ascending rank; a character is there before all of them."""
        return -1.0 if len(piece) == 1 else -self.score[piece]

    def is_stable(self, left: str, right: str) -> bool:
        """Do the two pieces stay apart when they are merged from characters?

        The merges beside the border are undone from the last to the first; at each step the two pieces at the
        border must not have a merge that would have come earlier.
        """
        if self.halves(right) is None:
            return False
        limit = float("inf")
        while left:
            over = self.score.get(left + right)
            if over is not None and -over < limit:
                return False
            if self._rank(left) > self._rank(right):
                limit, left = self._rank(left), self.halves(left)[1]
            elif len(right) > 1:
                # of equal merges the left one comes first
                limit, right = self._rank(right) + 0.5, self.halves(right)[0]
            else:
                return True
        return True

    def _states(self, words: list[str]) -> Iterator[tuple[str, list[str], list[int], list[bytes]]]:
        """The sorted distinct ``words``, which hold the mark at their start only, with the states of their prefixes.

        Of each prefix: the piece that ends it, where that piece starts, and the ids up to its end.
        """
        ids, stable, reach, packed = self.ids, self.stable, self.reach, self.packed
        if len(stable) >= CACHED_PAIRS:
            stable.clear()
        last, start, done = [""], [0], [b""]
        before = ""
        for word in words:
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1:], start[common + 1:], done[common + 1:]
            for end in range(common + 1, len(word) + 1):
                far = reach.get(word[end - 2:end], 1) if end > 1 else 1
                for at in range(end - far if far < end else 0, end):
                    piece = word[at:end]
                    if piece in ids or at == end - 1:
                        key = (last[at], piece)
                        fits = stable.get(key)
                        if fits is None:
                            fits = stable[key] = self.is_stable(*key)
                        if fits:
                            last.append(piece)
                            start.append(at)
                            done.append(done[at] + (packed.get(piece) or self.numbers([piece])))
                            break
            yield word, last, start, done
            before = word

    def segment_all(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each of the sorted distinct ``words``, which hold the mark at their start only."""
        for word, last, start, _ in self._states(words):
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end = start[end]
            yield word, pieces[::-1]

    def numbers(self, pieces: list[str]) -> bytes:
        """Ids as 32-bit integers; a character outside the vocabulary becomes its bytes."""
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is None:
                out.extend(self.byte_id[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(known)
        return array("i", out).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty texts."""
        cut = [self._marked(t) for t in texts]
        new = {w for ws in cut for w in ws if w not in self.words}
        runs = {w for w in new if MARK in w[1:]}       # runs of blanks tie in score, so they are merged one by one
        for word, _, _, done in self._states(sorted(new - runs)):
            self.words[word] = done[-1]
        for word in runs:
            blanks = len(word) - len(word.lstrip(MARK))
            self.words[word] = self.numbers(self._after_blanks(word, blanks))
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in cut]
        if len(self.words) > CACHED_WORDS:      # full: what came first, with the common words, stays
            for w in new:
                del self.words[w]
        return out

    def _after_blanks(self, word: str, blanks: int) -> list[str]:
        """A run of blanks keeps its last one for the word, unless the word merges with none."""
        return self.merged(word) if len(word) <= 64 else self._long_run(word, blanks)

    def _long_run(self, word: str, blanks: int) -> list[str]:
        rest = next(iter(self.segment_all([word[blanks - 1:]])))[1] if blanks < len(word) else []
        if rest and rest[0] != MARK:
            return self._run(blanks - 1) + rest
        return self._run(blanks) + rest[1:]

    def _run(self, n: int) -> list[str]:
        """Merges of equal score take the leftmost pair first: the run grows from the left to the longest piece."""
        top = max((len(p) for p in self.ids if p.strip(MARK) == ""), default=1)
        out = []
        while n > 0:
            take = min(n, top)
            out.extend(self.merged(MARK * take))
            n -= take
        return out

    @staticmethod
    def _marked(text: str | None) -> list[str]:
        """Marked words: each starts with a mark; of a run of blanks all marks stay with the word after it."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of a file, once per worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts of about ``SLICE`` characters at a time; the others stay as they lie in the column."""
    part, size = [], 0
    for x in texts:
        t = x.as_py()
        part.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield part
            part, size = [], 0
    yield part


def encoded(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (``doc_id``) of ``docs``, with ``ids array<int>`` of ``text``.

    Null and empty texts have no ids. Every row is encoded by itself, so repeated rows have equal ids; other
    columns of ``docs`` play no part. An empty table gives an empty result.
    """
    path, carry = path or model_path(), carry or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(batch.num_columns - 1)):
                ids = [np.frombuffer(x, np.int32) for x in model.encode(part)]
                ends = np.cumsum([0] + [len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*carry, "ids"])
                at += len(part)
    frame = docs.select(*[docs[f"`{c}`"] for c in carry], docs["text"].alias("_text"))
    return frame.mapInArrow(run, frame.select(*carry).schema.add("ids", ArrayType(IntegerType())))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null and no ids give an empty text. A mark in a text comes back as a blank."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    frame = rows.select("doc_id", "ids")
    return frame.mapInArrow(run, frame.select("doc_id").schema.add("text", "string"))


def digests(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text_crc32, same_text`` of encoded rows (``doc_id, text, ids``).

    The checksums are those of the ids as 32-bit integers and of the decoded text; ``same_text`` tells whether
    the decoded text is the given one, where a mark counts as a blank and null as empty.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = []
            for text, ids in zip(batch.column(1), batch.column(2)):
                ids = ids.values.to_numpy()
                back = model.decode(ids)
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()),
                            back == (text.as_py() or "").replace(MARK, " ")))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             ["doc_id", "n_ids", "ids_crc32", "text_crc32", "same_text"])
    frame = rows.select("doc_id", "text", "ids")
    return frame.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, same_text boolean")
