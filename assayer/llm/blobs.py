"""Compact byte strings of number arrays, for shuffles of many small numbers."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: Codes below this are ranks in a dictionary; all others are from 2**63 on.
ESCAPE = 1 << 20
_WRAP = np.uint64(2 * ESCAPE - 1)


class Near:
    """Wraps an array of ids to be stored as differences: runs of ascending values take fewer bytes."""

    def __init__(self, values: np.ndarray):
        self.values = values


class Codes:
    """Wraps an array of codes, most of which are small; near: as differences."""

    def __init__(self, values: np.ndarray, near: bool = False):
        self.values, self.near = values, near


def fixed(x: np.ndarray) -> np.ndarray:
    """Reals as whole multiples of 2**-32, signs folded in: five bytes for most logarithms, and sums without rounding."""
    v = np.rint(x * 2.0**32).astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unfixed(z: np.ndarray) -> np.ndarray:
    v = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
    return v / 2.0**32


_PLAIN, _REAL, _NEAR, _CODES, _NEAR_CODES = range(5)


def dump(*arrays: np.ndarray | Near | Codes) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, doubles in eight; byte planes, then zstd."""
    parts: list[tuple[int, np.ndarray]] = []
    for x in arrays:
        if isinstance(x, Near):
            parts.append((_NEAR, np.diff(x.values.astype(np.uint64), prepend=np.uint64(0))))
        elif isinstance(x, Codes):
            small = np.minimum(x.values, np.uint64(ESCAPE))
            kind = _NEAR_CODES if x.near else _CODES
            parts += [(kind, np.diff(small, prepend=np.uint64(0)) & _WRAP if x.near else small), (_PLAIN, x.values[x.values >= ESCAPE])]
        else:
            parts.append((_REAL if x.dtype == np.float64 else _PLAIN, x))
    out, squeeze = [struct.pack("<B", len(parts))], zstandard.ZstdCompressor(level=1)
    for kind, x in parts:
        flat = np.ascontiguousarray(x, np.float64 if kind == _REAL else np.uint64).view(np.uint64)
        width = 8 if kind == _REAL else max(1, (int(flat.max()).bit_length() + 7) // 8 if len(flat) else 1)
        body = squeeze.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        out += [struct.pack("<BBII", kind, width, len(flat), len(body)), body]
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    """The arrays of dump: uint64 or float64."""
    out, at, open_, codes = [], 1, zstandard.ZstdDecompressor(), None
    for _ in range(data[0]):
        kind, width, n, size = struct.unpack_from("<BBII", data, at)
        at += struct.calcsize("<BBII")
        planes = np.frombuffer(open_.decompress(data[at : at + size], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
        flat = np.zeros((n, 8), np.uint8)
        flat[:, :width] = planes.T
        values = flat.reshape(-1).view(np.float64 if kind == _REAL else np.uint64)
        at += size
        if codes is not None:
            codes[codes == ESCAPE] = values
            out.append(codes)
            codes = None
        elif kind in (_CODES, _NEAR_CODES):
            codes = np.cumsum(values, dtype=np.uint64) & _WRAP if kind == _NEAR_CODES else values
        else:
            out.append(np.cumsum(values, dtype=np.uint64) if kind == _NEAR else values)
    return out
