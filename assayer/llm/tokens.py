"""Vectorised splitting and hashing of texts inside Arrow batches.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text; A-Z count as a-z
unless asked otherwise. Its 64-bit hash is multilinear (a random table value per byte times a random odd multiplier per position),
so two different words collide with a probability of about 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_POSITIONS = 4096
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_MULT = _rng.integers(0, 2**64, _POSITIONS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a term: digits, letters of ASCII, and all bytes of other characters.
TERM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
#: Bytes with A-Z as a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_slices(column: pa.Array, target: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `target` bytes of text each, so that temporaries stay small."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, int(offsets[lo]) + target, "right"))
        hi = min(len(column), max(lo + 1, hi - 1))
        yield lo, hi
        lo = hi


def as_text(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty strings and 32-bit offsets."""
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def split_words(texts: pa.Array, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document index, words per document) of every longest run of bytes inside words, for a slice of texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none, np.zeros(len(texts), np.int64)
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return data, start, end, doc, np.bincount(doc, minlength=len(texts))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0, fold: bool = True) -> np.ndarray:
    """The hash of data[start:end] for ascending spans that do not overlap; fold: A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    values = (_FOLDED if fold else _BYTE)[data[np.repeat(start, size) + at]]
    if int(size.max()) > _POSITIONS:
        turn = (at // _POSITIONS).astype(np.uint64)
        at = at % _POSITIONS
        values = values * (turn * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + turn
    values *= _MULT[at]
    hashed = np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(hashed + np.uint64(salt)) if salt else hashed


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
