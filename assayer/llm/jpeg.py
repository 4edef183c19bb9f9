"""Progressive JPEG in numpy, many images at a time.

Entropy-coded data is cut at restart markers; all stretches of all images that use the same tables are decoded
in step, one symbol of each at a time, so that the work per symbol is a few array operations. Encoding is a
sequence of array operations too. Coefficients are kept in zigzag order.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))]
#: Blocks (or, with several components, groups of blocks) between two restart markers of what we write.
RESTART = 4
_SIZE = np.array([int(v).bit_length() for v in range(2048)])
_BLOCK_ENDS, _SECOND_LOOK = 1 << 10, 1 << 11


def _basis() -> np.ndarray:
    """(coefficient in zigzag order, pixel) of the 8 x 8 inverse DCT."""
    x = np.arange(8)
    c = np.where(x == 0, math.sqrt(0.5), 1.0)[:, None] / 2 * np.cos((2 * x[None] + 1) * x[:, None] * math.pi / 16)
    return np.einsum("ur,vc->uvrc", c, c).reshape(64, 64)[ZIGZAG]


BASIS = _basis()


class Huffman:
    """A canonical code from (code length, symbol) pairs in the order of a DHT segment."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.counts = [sum(n == k for n, _ in pairs) for k in range(1, 17)]
        self.symbols = [s for _, s in pairs]
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.lookup = np.zeros(1 << 16, np.int64)
        code = last = 0
        for n, s in pairs:
            code <<= n - last
            last = n
            self.code[s], self.length[s] = code, n
            self.lookup[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        self.segment = bytes(self.counts) + bytes(self.symbols)
        self._whole: np.ndarray | None = None

    def whole(self) -> np.ndarray:
        """By the next 16 bits, for codes of the first pass over a band: value << 16, flags, zeros to skip << 5, bits taken.

        _BLOCK_ENDS: nothing more in this block. _SECOND_LOOK: longer than 16 bits, or the end of several blocks; nothing else is set.
        """
        if self._whole is None:
            bits = np.arange(1 << 16)
            symbol, length = self.lookup & 255, self.lookup >> 8
            run, size = symbol >> 4, symbol & 15
            low = np.where(size > 0, bits >> (16 - length - size).clip(0, 16) & ((1 << size) - 1), 0)
            value = np.where((size > 0) & (low < (1 << size >> 1)), low - (1 << size) + 1, low)
            plain = (length > 0) & (length + size <= 16) & ((size > 0) | (run == 15))
            self._whole = np.where(plain, value * 65536 + (run << 5) + length + size, np.where((symbol == 0) & (length > 0), _BLOCK_ENDS + length, _SECOND_LOOK))
        return self._whole

    @classmethod
    def of(cls, lengths: dict[int, int]) -> Huffman:
        return cls(sorted((n, s) for s, n in lengths.items()))


#: Frequent bytes of text, most frequent first. They become the small coefficients.
FREQUENT = b" etnahiorsdulc.gbf,wympvkxqzj\n\xc3\xa9ETANOISRHDLCU!-'\":;0123456789"
_RANKED = FREQUENT + bytes(b for b in range(256) if b not in FREQUENT)
#: The coefficient of every byte: 0 for the most frequent, then 2, -2, 3, -3, ... so that no value is lost in the first approximation.
TO_VALUE = np.zeros(256, np.int16)
TO_VALUE[list(_RANKED)] = [0, *((k + 1) // 2 * (1 if k % 2 else -1) + (1 if k % 2 else -1) for k in range(1, 256))]
#: The byte of every coefficient, from -256 on.
TO_BYTE = np.zeros(512, np.uint8)
TO_BYTE[TO_VALUE.astype(np.int64) + 256] = np.arange(256)

# Code lengths for coefficients so ranked, halved in the first pass.
DC_CODE = Huffman.of({2: 2, 3: 2, 1: 3, 0: 3, 4: 4, 5: 4, 6: 5, 7: 7, 8: 7, 9: 7})
_USUAL = {1: 2, 2: 2, 3: 3, 4: 4, 17: 4, 18: 4, 5: 5, 6: 5, 19: 6, 20: 6, 0: 7, 22: 8, 7: 9, 21: 9, 33: 9, 34: 9, 35: 9, 8: 11, 0xF0: 11}
AC_CODE = Huffman.of(_USUAL | {s: 11 for r in range(1, 16) for s in range(r << 4 | 1, r << 4 | 9) if s not in _USUAL})
FIX_CODE = Huffman.of({0: 1, 0xF0: 7} | {r << 4 | 1: 6 for r in range(16)})
#: (components, first and last coefficient, bits approximated before and now) of the scans we write.
SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1),
         ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


def _pack_bits(value: np.ndarray, bits: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each part) of values of up to 31 bits in order, so many to a part; parts are filled up with ones."""
    ends = np.cumsum(bits)
    part_ends = np.concatenate([[0], ends])[np.cumsum(items)]
    total = np.diff(part_ends, prepend=0)
    size = (total + 7) >> 3
    first = np.cumsum(size) - size
    at = ends - bits + np.repeat(first * 8 - (part_ends - total), items)
    pad = size * 8 - total
    value = np.concatenate([value, (1 << pad) - 1])
    at = np.concatenate([at, first * 8 + total])
    bits = np.concatenate([bits, pad])
    wide = value.astype(np.uint64) << (64 - (at & 31) - bits).clip(0, 63).astype(np.uint64)
    word, n = at >> 5, int(size.sum()) // 4 + 2
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n + 1)
    low = wide & np.uint64(0xFFFFFFFF)
    over = np.flatnonzero(low)
    words += np.bincount(word[over] + 1, low[over].astype(np.float64), n + 1)
    return words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(size.sum())], np.append(first, size.sum())


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _dc_items(v: np.ndarray, part: np.ndarray, al: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v: (groups, 6) DC coefficients in the order Y Y Y Y Cb Cr; (bits to write, their number, items per group)."""
    six = np.full(len(v), 6)
    if refine:
        return (v >> al & 1).ravel(), np.ones(v.size, np.int64), six
    v = v >> al
    new = np.concatenate([[True], part[1:] != part[:-1]])
    before = np.empty_like(v)
    before[:, 1:4] = v[:, :3]
    before[1:, 0], before[1:, 4:] = v[:-1, 3], v[:-1, 4:]
    before[new, 0], before[new, 4:] = 0, 0
    size, low = _magnitude((v - before).ravel())
    return DC_CODE.code[size] << size | low, DC_CODE.length[size] + size, six


def _item_tables() -> tuple[np.ndarray, np.ndarray]:
    """(bits to write, their number) by 2048 * run + value + 1024, for runs below 16."""
    v = np.arange(-1024, 1024)
    size, low = _magnitude(v.clip(-1023, 1023))
    code = np.arange(16)[:, None] << 4 | size.clip(0, 15)
    return (AC_CODE.code[code] << size | low).ravel(), (AC_CODE.length[code] + size).ravel()


_ITEM, _ITEM_BITS = _item_tables()


def _ac_items(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pass over a band, v (blocks, band), already shifted: (bits to write, their number, items per block)."""
    blocks, band = v.shape
    flat = v.ravel()
    at = np.flatnonzero(flat)
    count = np.count_nonzero(v, axis=1)
    some = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[some]
    run = np.diff(at, prepend=0) - 1
    run[first] = at[first] - some * band
    last = np.full(blocks, -1)
    last[some] = at[first + count[some] - 1] - some * band
    stop = last < band - 1
    skips = run >> 4
    per_block = count + stop
    if skips.any():
        per_block = per_block + np.bincount(np.repeat(np.arange(blocks), count), skips, blocks).astype(np.int64)
        place = np.cumsum(1 + skips) - 1
    else:
        place = np.arange(len(at))
    place = place + np.repeat(np.cumsum(stop) - stop, count)
    n = int(per_block.sum())
    value, bits = np.full(n, AC_CODE.code[0xF0]), np.full(n, AC_CODE.length[0xF0])
    index = (run & 15) * 2048 + flat[at] + 1024
    value[place], bits[place] = _ITEM[index], _ITEM_BITS[index]
    ends = np.cumsum(per_block)[stop] - 1
    value[ends], bits[ends] = AC_CODE.code[0], AC_CODE.length[0]
    return value, bits, per_block


def _fix_bits(v: np.ndarray, al: int, blocks_per_part: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(bytes, first byte of each part) of a correction pass that finds no new coefficient: per block its end, then one bit per coefficient."""
    size = np.abs(v) >> al
    if (size == 1).any():
        return None
    old = np.flatnonzero(size)
    count = np.count_nonzero(size, axis=1)
    ends = np.cumsum(count + 1)
    part_ends = ends[np.cumsum(blocks_per_part) - 1]
    total = np.diff(part_ends, prepend=0)
    room = (total + 7) >> 3
    first = np.cumsum(room) - room
    shift = first * 8 - (part_ends - total)
    one = np.ones(int(room.sum()) * 8, np.uint8)  # parts are filled up with ones
    place = np.repeat(shift, blocks_per_part) + ends - (count + 1)
    one[place] = 0  # the code of an end is the bit 0
    one[np.arange(len(old)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(place + 1, count)] = size.ravel()[old] & 1
    return np.packbits(one), np.append(first, room.sum())


def _fix_items(v: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correction pass over a band, v (blocks, band), unshifted: (bits to write, their number, items per block). Symbols precede the correction bits they pass."""
    size = np.abs(v) >> al
    old, new = size > 1, size == 1
    blocks = len(v)
    empty = ~(old | new)
    some = np.flatnonzero(new.any(axis=1))
    point, code = new.copy(), np.zeros(v.shape, np.int64)
    z, w = np.cumsum(empty[some], axis=1), new[some]
    base = np.maximum.accumulate(np.where(w, z, 0), axis=1)
    base = np.concatenate([np.zeros((len(some), 1), base.dtype), base[:, :-1]], axis=1)
    done = np.cumsum(w, axis=1)
    skip = empty[some] & ((z - base) % 16 == 0) & (z > base) & (done < done[:, -1:])
    point[some] |= skip
    code[some] = np.where(skip, 0xF0, (z - base) % 16 << 4 | 1)
    group = np.cumsum(point, axis=1) - point
    stop = ~new[:, -1]
    symbols = point.sum(axis=1) + stop
    before = np.cumsum(symbols) - symbols
    row, col = np.nonzero(old)
    own = before[row] + group[row, col]
    passed = np.bincount(own, minlength=int(symbols.sum()))
    n = int(symbols.sum()) + len(row)
    value, bits = np.zeros(n, np.int64), np.ones(n, np.int64)
    value[np.arange(len(row)) + own + 1] = size[row, col] & 1
    place = np.arange(len(passed)) + np.cumsum(passed) - passed
    prow, pcol = np.nonzero(point)
    at = place[before[prow] + group[prow, pcol]]
    c = code[prow, pcol]
    sign = (v[prow, pcol] > 0).astype(np.int64)
    value[at] = np.where(c == 0xF0, FIX_CODE.code[c], FIX_CODE.code[c] << 1 | sign)
    bits[at] = FIX_CODE.length[c] + (c != 0xF0)
    at = place[(before + symbols - 1)[stop]]
    value[at], bits[at] = FIX_CODE.code[0], FIX_CODE.length[0]
    return value, bits, symbols + np.bincount(row, minlength=blocks)


def _marked(data: np.ndarray, first: np.ndarray, image: np.ndarray, number: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes with stuffed zeros and restart markers between the parts of an image; first byte per image."""
    full = data == 0xFF
    same = np.append(image[1:] == image[:-1], False)
    of = np.repeat(np.arange(len(image)), np.diff(first))
    marks = np.cumsum(same) - same
    at = np.arange(len(data)) + np.cumsum(full) - full + 2 * marks[of]
    size = np.bincount(of, 1 + full, len(image)).astype(np.int64) + 2 * same
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[at] = data
    out[end[same] - 2] = 0xFF
    out[end[same] - 1] = 0xD0 + number[same] % 8
    return out, np.concatenate([[0], np.cumsum(np.bincount(image, size, images).astype(np.int64))])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = b"".join([
    _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xDD, struct.pack(">H", RESTART)),
    _segment(0xC4, b"\x00" + DC_CODE.segment), _segment(0xC4, b"\x10" + AC_CODE.segment), _segment(0xC4, b"\x11" + FIX_CODE.segment)])


def grid(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups across and down of the image that holds so many blocks, six to a group (Y Y Y Y Cb Cr)."""
    groups = np.maximum(1, -(-blocks // 6))
    across = np.ceil(np.sqrt(groups)).astype(np.int64)
    return across, -(-groups // across)


def encode(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """One progressive 4:2:0 JPEG per payload: each 64 bytes, as TO_VALUE has them, are the coefficients of a block.

    The comment segment tells how many bytes there are, and how many of them are payload proper.
    """
    blocks = np.array([len(p) // 64 for p in payloads], np.int64)
    across, down = grid(blocks)
    groups = across * down
    base = np.cumsum(groups * 6) - groups * 6
    image = np.repeat(np.arange(len(payloads)), groups)
    t = np.arange(len(image)) - np.repeat(np.cumsum(groups) - groups, groups)
    row, col = t // across[image], t % across[image]
    wide = 2 * across[image]
    luma = [base[image] + (2 * row + v) * wide + 2 * col + h for v in (0, 1) for h in (0, 1)]
    chroma = [base[image] + 4 * groups[image] + t, base[image] + 5 * groups[image] + t]
    order = np.stack(luma + chroma, 1)
    coefficients = np.zeros((int((groups * 6).sum()), 64), np.int16)
    raw = TO_VALUE[np.frombuffer(b"".join(payloads), np.uint8)].reshape(-1, 64)
    coefficients[np.arange(len(raw)) + np.repeat(base - (np.cumsum(blocks) - blocks), blocks)] = raw
    kinds = []
    for count, shift in ((4 * groups, 0 * groups), (groups, 4 * groups), (groups, 5 * groups)):
        of = np.repeat(np.arange(len(payloads)), count)
        own = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        kinds.append((coefficients[base[of] + shift[of] + own], of, own // RESTART))
    bodies = []
    for components, lo, hi, ah, al in SCANS:
        of, number = (image, t // RESTART) if lo == 0 else kinds[components[0]][1:]
        change = np.concatenate([[True], (of[1:] != of[:-1]) | (number[1:] != number[:-1])])
        start = np.flatnonzero(change)
        per_part = np.diff(np.append(start, len(of)))
        packed = None
        if lo == 0:
            items = _dc_items(coefficients[order, 0].astype(np.int64), np.cumsum(change) - 1, al, ah > 0)
        else:
            v = kinds[components[0]][0][:, lo : hi + 1]
            packed = _fix_bits(v, al, per_part) if ah else None
            if packed is None:
                items = _fix_items(v, al) if ah else _ac_items(np.sign(v) * (np.abs(v) >> al))
        data, first = packed or _pack_bits(*items[:2], np.add.reduceat(items[2], start))
        data, edge = _marked(data, first, of[start], number[start], len(payloads))
        ids = 0x00 if lo == 0 else (0x01 if ah else 0x00)
        head = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, ids]) for c in components) + bytes([lo, hi, ah << 4 | al]))
        bodies.append((head, data.tobytes(), edge.tolist()))
    out = []
    for k, n in enumerate(sizes):
        frame = struct.pack(">BHHB", 8, int(down[k]) * 16, int(across[k]) * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", len(payloads[k]), n)), _TABLES[:69], _segment(0xC2, frame), _TABLES[69:]]
        for head, data, edge in bodies:
            parts += [head, data[edge[k] : edge[k + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass
class Scan:
    """begin, end: the range of the entropy-coded bytes; restart: blocks or groups between markers, 0 for none."""

    components: list[int]
    dc: list[Huffman | None]
    ac: list[Huffman | None]
    band: tuple[int, int]
    ah: int
    al: int
    restart: int
    begin: int
    end: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    sampling: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    names: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)

    def grids(self) -> list[tuple[int, int, int, int]]:
        """Per component: blocks down and across with the padding of whole groups, and without."""
        hm, vm = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        down, across = -(-self.height // (8 * vm)), -(-self.width // (8 * hm))
        return [(down * v, across * h, -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)) for h, v in self.sampling]


_codes: dict[bytes, list[tuple[int, int, Huffman]]] = {}
_quants: dict[bytes, list[tuple[int, np.ndarray]]] = {}


def _code_tables(body: bytes) -> list[tuple[int, int, Huffman]]:
    """(class, number, code) of a DHT segment."""
    if body not in _codes:
        found, p = [], 0
        while p < len(body):
            counts = body[p + 1 : p + 17]
            symbols = iter(body[p + 17 : p + 17 + sum(counts)])
            found.append((body[p] >> 4, body[p] & 15, Huffman([(n, next(symbols)) for n in range(1, 17) for _ in range(counts[n - 1])])))
            p += 17 + sum(counts)
        _codes[body] = found
    return _codes[body]


def _quant_tables(body: bytes) -> list[tuple[int, np.ndarray]]:
    if body not in _quants:
        found, p = [], 0
        while p < len(body):
            wide = body[p] >> 4
            found.append((body[p] & 15, np.frombuffer(body, ">u2" if wide else "u1", 64, p + 1).astype(np.float64)))
            p += 129 if wide else 65
        _quants[body] = found
    return _quants[body]


def markers(data: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Where FF stands before a marker code: (all but restarts, restarts)."""
    at = np.flatnonzero(data[:-1] == 0xFF)
    code = data[at + 1]
    restarts = (code & 0xF8) == 0xD0
    return at[(code != 0) & ~restarts].tolist(), at[restarts]


def parse(data: bytes, at: int = 0, solid: list[int] | None = None) -> Image:
    """Headers, tables and the byte ranges of the scans of the progressive JPEG that begins at `at`."""
    image, dc, ac, restart = Image(), {}, {}, 0
    solid = markers(np.frombuffer(data, np.uint8))[0] if solid is None else solid
    at += 2
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            image.quant.update(_quant_tables(body))
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC4:
            for kind, number, code in _code_tables(body):
                (ac if kind else dc)[number] = code
        elif marker == 0xC2:
            image.height, image.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            for k in range(body[5]):
                name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.names.append(name)
                image.sampling.append((hv >> 4, hv & 15))
                image.tables.append(q)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            n = body[0]
            pairs = [(image.names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            end = solid[bisect.bisect_left(solid, at)]
            image.scans.append(Scan([c for c, _ in pairs], [dc.get(t >> 4) for _, t in pairs], [ac.get(t & 15) for _, t in pairs], (lo, hi), approx >> 4, approx & 15, restart, at, end))
            at = end
    return image


class _Bits:
    """64-bit windows on unstuffed data."""

    def __init__(self, data: np.ndarray):
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 0) | (data[:-1] != 0xFF)
        self.place = np.append(np.cumsum(keep) - keep, keep.sum())
        clean = np.concatenate([data[keep], np.zeros(16, np.uint8)])
        n = len(clean) - 8
        self.window = np.zeros(n, np.uint64)
        for k in range(8):
            self.window |= clean[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.clean = clean

    def at(self, bit: np.ndarray) -> np.ndarray:
        return self.window[bit >> 3] << (bit & 7).view(np.uint64)

    def single(self, bit: np.ndarray) -> np.ndarray:
        return (self.clean[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def _take(window: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The leading size bits as a number."""
    return np.where(size > 0, window >> (64 - size).clip(0, 63).astype(np.uint64), 0).astype(np.int64)


def _signed(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (low < (1 << size >> 1)), low - (1 << size) + 1, low)


def _decode_dc(bits: _Bits, pos: np.ndarray, blocks: list[np.ndarray], codes: list[Huffman], kinds: list[int], al: int, out: np.ndarray) -> None:
    """blocks[t]: for each part its t-th block, or -1 beyond its end; kinds[t], codes[t]: component and table."""
    last = np.zeros((max(kinds) + 1, len(pos)), np.int64)
    for block, code, kind in zip(blocks, codes, kinds, strict=True):
        on = block >= 0
        window = bits.at(pos)
        hit = code.lookup[(window >> np.uint64(48)).view(np.int64)]
        size, length = hit & 255, hit >> 8
        value = _signed(_take(window << length.view(np.uint64), size), size)
        last[kind][on] += value[on]
        out[block[on], 0] = last[kind][on] << al
        pos = np.where(on, pos + length + size, pos)


def _decode_ac(bits: _Bits, pos: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray, code: Huffman, lo: int, hi: int, al: int, out: np.ndarray) -> None:
    """One symbol of every part at a time; Huffman.whole settles those that fit in 16 bits with their value, the others take a second look."""
    table, flat = code.whole(), out.reshape(-1)
    base = order * 64
    spare = np.append(base, 0)
    k, first = np.full(len(pos), lo), base[at]
    while len(pos):
        window = bits.at(pos)
        hit = table[(window >> np.uint64(48)).view(np.int64)]
        pos = pos + (hit & 31)
        k = k + (hit >> 5 & 15)
        value = hit >> 16
        done = hit & _BLOCK_ENDS != 0
        odd = hit & _SECOND_LOOK
        if odd.any():
            some = np.flatnonzero(odd)
            own = code.lookup[(window[some] >> np.uint64(48)).view(np.int64)]
            symbol, length = own & 255, own >> 8
            run, size = symbol >> 4, symbol & 15
            rest = window[some] << length.view(np.uint64)
            value[some] = _signed(_take(rest, size), size)
            stop = (size == 0) & (run < 15)
            pos[some] += length + np.where(stop, run, size)
            k[some] += np.where(stop, 0, run)
            blocks = np.where(stop, (1 << run) + _take(rest, np.where(stop, run, 0)), 0)
            at[some] += blocks - stop  # the last one is counted below
            done[some] = stop
        real = np.flatnonzero(value)
        flat[first[real] + k[real]] = value[real] << al
        done |= k >= hi
        k += 1
        over = np.flatnonzero(done)
        if len(over):
            at[over] += 1
            k[over] = lo
            alive = at < end
            if alive.all():
                first[over] = spare[at[over]]
            else:
                pos, at, end, k = pos[alive], at[alive], end[alive], k[alive]
                first = spare[at]


def _fix_ac(bits: _Bits, pos: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray, code: Huffman, lo: int, hi: int, al: int, out: np.ndarray) -> None:
    k, left = np.full(len(pos), lo), np.zeros(len(pos), np.int64)
    column = np.arange(lo, hi + 1)
    while len(pos):
        window = bits.at(pos)
        hit = code.lookup[(window >> np.uint64(48)).view(np.int64)]
        read = left == 0
        symbol, length = np.where(read, hit & 255, 0), np.where(read, hit >> 8, 0)
        run, size = symbol >> 4, symbol & 15
        rest = window << length.view(np.uint64)
        stop = read & (size == 0) & (run < 15)
        left = np.where(stop, (1 << run) + _take(rest, np.where(stop, run, 0)), left)
        sign = (rest >> np.uint64(63)).astype(np.int64)
        pos = pos + length + np.where(stop, run, size)
        ending = left > 0
        block = order[at]
        band = out[block, lo : hi + 1]
        old = band != 0
        if not (ending & (k == lo)).all():
            old &= column >= k[:, None]
        target = np.full(len(pos), hi + 1)
        some = np.flatnonzero(~ending)
        if len(some):
            zeros = np.cumsum((band[some] == 0) & (column >= k[some][:, None]), axis=1) == (run[some] + 1)[:, None]
            target[some] = np.where(zeros.any(axis=1), lo + zeros.argmax(axis=1), hi + 1)
            old[some] &= column < target[some][:, None]
        count = np.count_nonzero(old, axis=1)
        at_bit = np.flatnonzero(old)
        first = np.cumsum(count) - count
        one = bits.single(np.arange(len(at_bit)) + np.repeat(pos - first, count)).astype(bool)
        flat = band.reshape(-1)
        flat[at_bit] += np.where(one, np.sign(flat[at_bit]) << al, 0).astype(band.dtype)
        out[block, lo : hi + 1] = band
        pos = pos + count
        new = ~ending & (size > 0) & (target <= hi)
        if new.any():
            out[block[new], target[new]] = np.where(sign[new] > 0, 1 << al, -(1 << al))
        left = np.where(ending, left - 1, 0)
        k = np.where(ending, hi + 1, target + 1)
        over = k > hi
        at, k = at + over, np.where(over, lo, k)
        alive = at < end
        if not alive.all():
            pos, at, end, k, left = pos[alive], at[alive], end[alive], k[alive], left[alive]


def decode_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, list[list[int]]]:
    """(images, all blocks' coefficients, first block of each image's components)."""
    data = b"".join(files)
    array = np.frombuffer(data, np.uint8)
    solid, restarts = markers(array) if files else ([], np.zeros(0, np.int64))
    images, at = [], 0
    for f in files:
        images.append(parse(data, at, solid))
        at += len(f)
    bits = _Bits(array)
    bases, layout, n = [], [], 0
    for image in images:
        own = []
        for down, across, real_down, real_across in image.grids():
            own.append((n, down, across, real_down, real_across, 0))
            n += down * across
        layout.append(own)
        bases.append([b[0] for b in own])
    out = np.zeros((n, 64), np.int16)
    orders: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(max((len(i.scans) for i in images), default=0)):
        alike: dict[tuple, list[int]] = {}
        for k, image in enumerate(images):
            if turn < len(image.scans):
                s = image.scans[turn]
                shape = tuple(image.sampling[c] for c in s.components) if len(s.components) > 1 else ()
                alike.setdefault((tuple(s.components), shape, s.band, s.ah, s.al, tuple(map(id, s.dc)), tuple(map(id, s.ac))), []).append(k)
        for (components, shape, *_), members in alike.items():
            key = (components, shape, tuple(members))
            if key not in orders:
                orders[key] = _scan_order([[layout[k][c] for c in components] for k in members], shape)
            _decode_scan(bits, restarts, [images[k] for k in members], turn, *orders[key], out)
    return images, out, bases


def _scan_order(grids: list[list[tuple]], shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(blocks in the order of the scan, one row per block or per group of blocks; rows per image)."""
    g = np.array(grids, np.int64)
    if shape:
        across = g[:, 0, 2] // shape[0][0]
        count = g[:, 0, 1] // shape[0][1] * across
    else:
        across, count = g[:, 0, 4], g[:, 0, 3] * g[:, 0, 4]
    of = np.repeat(np.arange(len(g)), count)
    t = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    row, col = t // across[of], t % across[of]
    if not shape:
        return (g[of, 0, 0] + row * g[of, 0, 2] + col)[:, None], count
    return np.stack([g[of, c, 0] + (row * v + y) * g[of, c, 2] + col * h + x for c, (h, v) in enumerate(shape) for y in range(v) for x in range(h)], 1), count


def _decode_scan(bits: _Bits, restarts: np.ndarray, images: list[Image], turn: int, order: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
    scan = images[0].scans[turn]
    (lo, hi), several = scan.band, len(scan.components) > 1
    own = np.array([(s.begin, s.end, s.restart) for i in images for s in (i.scans[turn],)], np.int64)
    low, high = np.searchsorted(restarts, own[:, 0]), np.searchsorted(restarts, own[:, 1])
    step = np.where(own[:, 2] > 0, own[:, 2], count)
    parts = np.minimum(high - low + 1, -(-count // step))
    of = np.repeat(np.arange(len(images)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.where(number == 0, own[of, 0], np.append(restarts, 0)[low[of] + np.maximum(number, 1) - 1] + 2)
    pos = bits.place[begin] * 8
    first = np.cumsum(count) - count
    at = first[of] + number * step[of]
    end = np.minimum(at + step[of], first[of] + count[of])
    if lo == 0:
        longest, width = int((end - at).max()), order.shape[1]
        if scan.ah:
            size = (end - at) * width
            which = np.repeat(np.arange(len(at)), size)
            local = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            block = order[at[which] + local // width, local % width]
            out[block, 0] |= bits.single(pos[which] + local).astype(np.int16) << scan.al
            return
        of = [k for k, c in enumerate(scan.components) for _ in range(images[0].sampling[c][0] * images[0].sampling[c][1] if several else 1)]
        blocks = [np.where(at + t < end, order[np.minimum(at + t, len(order) - 1), u], -1) for t in range(longest) for u in range(width)]
        _decode_dc(bits, pos, blocks, [scan.dc[k] for k in of] * longest, of * longest, scan.al, out)
    else:
        (_fix_ac if scan.ah else _decode_ac)(bits, pos, at, end, order[:, 0], scan.ac[0], lo, hi, scan.al, out)


def tensors(images: list[Image], coefficients: np.ndarray, bases: list[list[int]]) -> Iterator[np.ndarray]:
    """Full-resolution (height, width, 3) RGB of each image; one component: grey."""
    quant = np.ones((len(coefficients), 64), np.float64) if any((t != 1).any() for i in images for t in i.quant.values()) else None
    if quant is not None:
        for image, base in zip(images, bases, strict=True):
            for b, (down, across, _, _), q in zip(base, image.grids(), image.tables, strict=True):
                quant[b : b + down * across] = image.quant[q]
    scaled = coefficients.astype(np.float64) if quant is None else coefficients * quant
    # the small addend settles ties alike, however many blocks are multiplied together
    pixels = np.clip(np.floor(scaled @ BASIS + (128.5 + 1e-7)), 0, 255).astype(np.int16)
    for image, base in zip(images, bases, strict=True):
        hm, vm = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
        planes = []
        for b, (down, across, _, _), (h, v) in zip(base, image.grids(), image.sampling, strict=True):
            plane = pixels[b : b + down * across].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
            if (h, v) != (hm, vm):
                plane = plane.repeat(vm // v, axis=0).repeat(hm // h, axis=1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            yield np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
            continue
        y, cb, cr = planes[0].astype(np.int32) * 65536, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)
        yield np.clip((rgb + 32768) >> 16, 0, 255).astype(np.uint8)
