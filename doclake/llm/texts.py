"""What several operators share: words of a text as columns, and as bytes inside a task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"    # with the blank, the characters that part words
# Upper-case ASCII becomes lower-case; every other ASCII character that is no letter or digit becomes a blank.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: Column) -> Column:
    """Maximal runs of characters other than blank and \\x09-\\x0D; none for null."""
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blanks, " "), "")


def alnum_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and non-ASCII characters; none for null.

    ``lower`` also changes letters outside ASCII, which no pattern or phrase of this package contains.
    """
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def space_tokens(text: str | None) -> list[bytes]:
    """``words`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def alnum_tokens(text: str | None) -> list[bytes]:
    """``alnum_words`` as UTF-8, with only A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(_ALNUM).split()


def crc_fold(doc_id: int | None, folds: int) -> int:
    """The fold of a document: crc32 of its id as text; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def packed(df: DataFrame, columns: list[str], carry: list[str] | None = None) -> DataFrame:
    """The row (or its columns ``carry``) as one struct ``_row`` beside ``columns``: no added column can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in carry or df.columns]).alias("_row"), *[df[f"`{c}`"] for c in columns])


def byte_slices(batch: pa.RecordBatch, column: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows at most, whose texts have about ``size`` bytes at most (a longer text is alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


# --- words of a whole Arrow column at once -----------------------------------

_CHUNK = 1 << 21      # bytes that are hashed together, which bounds the working arrays
_STEP = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), list(b" " + SPACES.encode()))
_IS_OTHER = np.isin(np.arange(256), [c for c in range(256) if _ALNUM[c] == 32])
_powers: dict[str, np.ndarray] = {"step": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def _power(name: str, size: int) -> np.ndarray:
    """Powers of the step (or of its inverse) mod 2^64."""
    if len(_powers[name]) < size:
        base = _STEP if name == "step" else pow(_STEP, -1, 1 << 64)
        factors = np.full(max(size, _CHUNK), base, np.uint64)
        factors[0] = 1
        _powers[name] = np.cumprod(factors)
    return _powers[name][:size]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _chunk_hashes(b: np.ndarray, cut: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in ``b``: a polynomial over the bytes of each, from running sums."""
    word = ~part[b]
    before = np.zeros(len(b), bool)
    before[1:] = word[:-1] & ~cut[1:]
    after = np.zeros(len(b), bool)
    after[:-1] = word[1:] & ~cut[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("step", len(b)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("back", len(b))[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts


def hashed_words(column: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, and bounds: row i has the words ``bounds[i]`` to ``bounds[i + 1]``.

    The words are those of ``space_tokens``, with ``alnum`` those of ``alnum_tokens``; null has none. The bytes
    are taken as they lie in the column, in chunks that end between two words.
    """
    part = _IS_OTHER if alnum else _IS_SPACE
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[low:high]
    rows = offsets - low
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):      # back to a row's start or behind a blank, else on to the next one
            row = rows[np.searchsorted(rows, end, "right") - 1]
            blanks = np.flatnonzero(part[raw[at:end]])
            end = max(int(row), at + int(blanks[-1]) + 1 if len(blanks) else 0)
            if end <= at:
                blanks = np.flatnonzero(part[raw[at + _CHUNK:]])
                following = rows[np.searchsorted(rows, at + _CHUNK, "left")]
                end = min(int(following), at + _CHUNK + int(blanks[0]) + 1 if len(blanks) else len(raw))
        b = np.frombuffer(raw[at:end].tobytes().lower(), np.uint8)
        cut = np.zeros(len(b), bool)
        inside = rows[np.searchsorted(rows, at):np.searchsorted(rows, end)] - at
        cut[inside] = True
        h, s = _chunk_hashes(b, cut, part)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), rows)


def word_hash(words: list[bytes]) -> np.ndarray:
    """The hashes that ``hashed_words`` gives to these words."""
    return hashed_words(pa.array([b" ".join(words).decode("utf-8", "replace")]))[0]
