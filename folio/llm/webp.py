"""Lossless WebP media columns: a decoder for the whole format and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal), back-references, the colour cache and groups of codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms; it returns pixel arrays. Streams of one code group without back-references and cache
are decoded by arrays: the code length at every bit position gives the position after one pixel, and following these is the only loop.

`media_digest` stores each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as 8-bit RGBA samples, 48 pixels a row and
4096 rows an image (a longer text has several images, one after the other), with prefix codes fitted to each image and, where they save, a packed palette,
references or the left predictor, and reads the stored bytes back. All of it is a map over rows; a row's memory is a few times its text.

Nulls: a null text is empty (192 spaces are stored). Repeated rows and equal texts have equal values. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, textnum

UNIT, ROW, MOST = 192, 48, 4096
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed by the format
CACHE_FACTOR = 0x1E35A7BD  # fixed by the format
#: Pixel offsets of the 120 short distance codes: the places above and left within 8 columns and 7 rows, by distance.
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


# -- prefix codes


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths; 0 for unused symbols (a single used symbol has length 0 too)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    weights = counts[used].tolist()
    while len(used) > 1:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(weights)), len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(weights)]) <= most:
            out[used] = depth[: len(weights)]
            break
        weights = [w // 2 + 1 for w in weights]
    return out


def _reversed_bits(bits: int) -> np.ndarray:
    x, out = np.arange(1 << bits, dtype=np.uint16), np.zeros(1 << bits, dtype=np.uint16)
    for _ in range(bits):
        out, x = out << np.uint16(1) | x & np.uint16(1), x >> np.uint16(1)
    return out


REVERSED = {bits: _reversed_bits(bits) for bits in range(1, 16)}


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols in code order, and their lengths."""
    used = np.flatnonzero(lengths)
    own = lengths[used]
    order = np.argsort(own, kind="stable")
    return used[order], own[order].astype(np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes."""
    codes = np.zeros(len(lengths), dtype=np.uint16)
    symbols, ln = _in_order(lengths)
    if len(symbols):
        first = np.cumsum(1 << (15 - ln)) - (1 << (15 - ln))  # codes as fractions of 2**15
        codes[symbols] = REVERSED[15][first & 0x7FFF]
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next bits, as many as the longest code has."""
    symbols, ln = _in_order(lengths)
    top = int(ln[-1])
    times = 1 << (top - ln)
    if int(times.sum()) > 1 << top:
        raise ValueError("too many codes")
    back = REVERSED[top]
    symbol, size = np.zeros(1 << top, dtype=np.int64), np.zeros(1 << top, dtype=np.int64)
    symbol[: times.sum()], size[: times.sum()] = np.repeat(symbols, times), np.repeat(ln, times)
    return symbol[back], size[back]


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class Code:
    """A prefix code of the stream."""

    def __init__(self, bits: Bits, alphabet: int):
        lengths, self.only = np.zeros(alphabet, dtype=np.uint8), None
        self.limited = True  # the stream says how many lengths follow
        if bits.read(1):  # simple
            two, wide = bits.read(1), bits.read(1)
            symbols = [bits.read(8 if wide else 1)]
            if two:
                symbols.append(bits.read(8))
            lengths[symbols] = 1
        else:
            first = np.zeros(19, dtype=np.uint8)
            for k in range(4 + bits.read(4)):
                first[LENGTH_ORDER[k]] = bits.read(3)
            self.limited = bool(bits.read(1))
            left = 2 + bits.read(2 + 2 * bits.read(3)) if self.limited else alphabet
            used = np.flatnonzero(first)
            symbol, size = ([int(used[0])], [0]) if len(used) == 1 else (x.tolist() for x in lookup(first))
            mask, values = len(symbol) - 1, [0] * alphabet
            byte = bits.at >> 3
            ahead, p = int.from_bytes(bits.data[byte : byte + 14 * alphabet // 8 + 16], "little"), bits.at & 7  # 7 bits a length and 7 more at most
            at, last = 0, 8
            while at < alphabet and left:
                left -= 1
                window = ahead >> p
                s, n = symbol[window & mask], size[window & mask]
                p += n
                if s < 16:
                    values[at] = s
                    last = s or last
                    at += 1
                else:
                    extra, base = ((2, 3), (3, 3), (7, 11))[s - 16]
                    times = base + (window >> n & ((1 << extra) - 1))
                    p += extra
                    if at + times > alphabet:
                        raise ValueError("code lengths run over the alphabet")
                    values[at : at + times] = [last if s == 16 else 0] * times
                    at += times
            bits.at = (byte << 3) + p
            lengths = np.array(values, dtype=np.uint8)
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.only = int(used[0]) if len(used) else 0
        self.lengths, self.most, self._tables, self._lists = lengths, int(used[-1]) if len(used) else 0, None, None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._tables is None:
            self._tables = lookup(self.lengths) if self.only is None else (np.full(1, self.only, dtype=np.int64), np.zeros(1, dtype=np.int64))
        return self._tables

    def next(self, bits: Bits) -> int:
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in self.tables())
        window = bits.peek(15) & (len(self._lists[0]) - 1)
        bits.at += self._lists[1][window]
        return self._lists[0][window]


def _codes(bits: Bits, alphabets: tuple[int, ...]) -> list[Code]:
    """The codes of a group. Bits that repeat those of the code before say the same code, where both say how many lengths follow."""
    out: list[Code] = []
    was = None
    for n in alphabets:
        start = bits.at
        if was and out[-1].limited and out[-1].most < n:
            begin, width = was
            whole = int.from_bytes(bits.data[begin >> 3 : (start + width >> 3) + 1], "little") >> (begin & 7)
            mask = (1 << width) - 1
            if whole & mask == whole >> (start - begin) & mask:
                out.append(out[-1])
                bits.at += width
                was = start, width
                continue
        out.append(Code(bits, n))
        was = start, bits.at - start
    return out


# -- decoder


def _length(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _by_arrays(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """n literal pixels (green, red, blue, alpha codes) as ARGB numbers."""
    data = np.frombuffer(bits.data, dtype=np.uint8)[bits.at >> 3 :]
    padded = np.concatenate([data, np.zeros(10, np.uint8)]).astype(np.int64)
    wide = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    window = (wide[:, None] >> np.arange(8)).ravel()
    place = np.arange(len(window))
    step, symbol = {}, {}
    for c in codes[:4]:
        if id(c) not in step:
            by_bits, size = c.tables()
            seen = window & (len(size) - 1)
            step[id(c)], symbol[id(c)] = place + size.take(seen, mode="clip"), (by_bits, seen)
    after = step[id(codes[0])]
    for c in codes[1:4]:
        after = step[id(c)].take(after, mode="clip")
    p, hop = bits.at & 7, memoryview(after)
    pixel = [p]
    add = pixel.append
    for _ in range(n):
        p = hop[p]
        add(p)
    bits.at = (bits.at >> 3 << 3) + p
    at, out = np.array(pixel[:n]), np.zeros(n, dtype=np.uint32)
    for c, shift in zip(codes[:4], (8, 16, 0, 24), strict=True):
        by_bits, seen = symbol[id(c)]
        out |= by_bits[seen[at]].astype(np.uint32) << np.uint32(shift)
        at = step[id(c)][at]
    return out


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, which, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        which = (_entropy_image(bits, across, (height + (1 << tile) - 1) >> tile, False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(-1, across).tolist()
        groups = max(map(max, which)) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [_codes(bits, (280 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and codes[0][0].most < 256:
        return _by_arrays(bits, codes[0], n)
    out, cache = [0] * n, [0] * max(cache_size, 1)
    at, cached = 0, 0

    def remember(upto: int) -> None:
        nonlocal cached
        for k in range(cached, upto):
            cache[(out[k] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
        cached = upto

    while at < n:
        g = codes[which[at // width >> tile][at % width >> tile] if which else 0]
        s = g[0].next(bits)
        if s < 256:
            red, blue, alpha = g[1].next(bits), g[2].next(bits), g[3].next(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _length(s - 256, bits)
            d = _length(g[4].next(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > n:
                raise ValueError("back-reference outside of the image")
            if d == 1:
                out[at : at + length] = [out[at - 1]] * length
            elif d >= length:
                out[at : at + length] = out[at - d : at - d + length]
            else:
                for k in range(at, at + length):
                    out[k] = out[k - d]
            at += length
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, dtype=np.uint32)


def _channels(x: np.ndarray) -> np.ndarray:
    return np.stack([x >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, top, right, corner) -> list[int]:
    """The prediction from the neighbours (lists A, R, G, B): left, top, top right, top left."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 10:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        from_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        from_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if from_left < from_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]


def _mode_at(modes: np.ndarray | None, bits: int, x: int, y: int) -> int:
    if not y:
        return 1 if x else 0
    return int(modes[y >> bits][x >> bits]) if x else 2


def add_prediction(residual: np.ndarray, modes: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    """Inverse predictor over (height, width, 4); with sign -1 the forward one."""
    height, width, _ = residual.shape
    if sign > 0 and (modes == 1).all():  # the pixel on the left everywhere: sums
        first = residual.copy()
        first[0, 0, 0] += 255
        first[:, 0] = np.cumsum(first[:, 0], axis=0)
        return np.cumsum(first, axis=1) & 255
    given, out = residual.tolist(), [[None] * width for _ in range(height)]
    known = out if sign > 0 else given
    for y in range(height):
        for x in range(width):
            left = known[y][x - 1] if x else None
            top = known[y - 1][x] if y else None
            corner = known[y - 1][x - 1] if x and y else None
            right = (known[y - 1][x + 1] if x + 1 < width else known[y][0]) if y and x else None
            p = predict(_mode_at(modes, bits, x, y), left, top, right, corner)
            out[y][x] = [(v + sign * q) & 255 for v, q in zip(given[y][x], p, strict=True)]
    return np.array(out, dtype=np.int64).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(c: np.ndarray, factors: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    """Inverse cross-colour transform over (height, width, 4); with sign -1 the forward one."""
    height, width, _ = c.shape
    f = factors[np.arange(height) >> bits][:, np.arange(width) >> bits]
    green_red, green_blue, red_blue = _signed(f[..., 3]), _signed(f[..., 2]), _signed(f[..., 1])
    green, out = _signed(c[..., 2]), c.copy()
    out[..., 1] = (c[..., 1] + sign * (green_red * green >> 5)) & 255
    red = out[..., 1] if sign > 0 else c[..., 1]
    out[..., 3] = (c[..., 3] + sign * ((green_blue * green >> 5) + (red_blue * _signed(red) >> 5))) & 255
    return out


def _decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == s[0] for s in steps):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            across, down = (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            steps.append((kind, size, _channels(_entropy_image(bits, across, down, False)).reshape(down, across, 4), now))
        elif kind == GREEN:
            steps.append((kind, 0, None, now))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_channels(_entropy_image(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, pack, palette, now))
            now = (now + (1 << pack) - 1) >> pack
    argb = _entropy_image(bits, now, height, True)
    if not steps:
        return argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
    image = _channels(argb).reshape(height, now, 4)
    for kind, size, table, was in reversed(steps):
        if kind == PREDICTOR:
            image = add_prediction(image, table[..., 2], size)
        elif kind == CROSS:
            image = cross_colour(image, table, size)
        elif kind == GREEN:
            image[..., 1] = (image[..., 1] + image[..., 2]) & 255
            image[..., 3] = (image[..., 3] + image[..., 2]) & 255
        else:
            index = image[..., 2]
            if size:
                each = 8 >> size
                index = (index[..., None] >> (np.arange(1 << size) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :was]
            full = np.zeros((256, 4), dtype=np.int64)  # an index behind the palette is transparent black
            full[: len(table)] = table
            image = full[index]
    return image[..., [1, 2, 3, 0]].astype(np.uint8)


def decode(data: bytes) -> list[np.ndarray]:
    """(height, width, RGBA) arrays of the WebP files that data holds one after the other."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        p, found = at + 12, None
        while p + 8 <= end:
            size = struct.unpack_from("<I", data, p + 4)[0]
            if data[p : p + 4] == b"VP8L":
                found = data[p + 8 : p + 8 + size]
            p += 8 + size + (size & 1)
        if found is None:
            raise ValueError("no lossless image")
        out.append(_decode_stream(found))
        at = end
    return out


# -- encoder


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Fields of 15 bits at most, least significant bit first: sums by 32-bit word, whose upper halves go to the next word."""
    end = np.cumsum(lengths, dtype=np.int64)
    at = end - lengths
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    whole = np.add.reduceat(values.astype(np.uint64) << (at & 31).astype(np.uint64), first)
    out = np.zeros(len(whole) + 1, dtype=np.uint32)
    out[:-1] = whole & np.uint64(0xFFFFFFFF)
    out[1:] |= (whole >> np.uint64(32)).astype(np.uint32)
    return out.astype("<u4").tobytes()[: int(end[-1] + 7) >> 3]


NIBBLE = np.array([int(f"{k:04b}"[::-1], 2) for k in range(16)], dtype=np.uint16)  # canonical code of sixteen symbols of four bits


Fields = tuple[list[int], list[int]]  # values and lengths of bit fields


def _code_fields(lengths: np.ndarray, only: int | None) -> Fields:
    """The bit fields that write a code."""
    if only is not None:
        return [1, 0, 1, only], [1, 1, 1, 8]
    n = max(2, int(np.flatnonzero(lengths)[-1]) + 1)
    wide = 3 if n - 2 < 256 else 4
    values = [0, 15, *(0 if s > 15 else 4 for s in LENGTH_ORDER), 1, wide, n - 2]
    return values + NIBBLE[lengths[:n]].tolist(), [1, 4, *[3] * 19, 1, 3, 2 + 2 * wide] + [4] * n


def container(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def _literal_fields(pixels: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """An image of literals, with one prefix code for all four channels."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    lengths = code_lengths(counts)
    only = int(np.argmax(counts)) if not lengths.any() else None
    v, n = _code_fields(lengths, only)
    values = np.array([0, *([0] * main), *(4 * v), 1, 0, 0, 0], dtype=np.uint16)
    sizes = np.array([1, *([1] * main), *(4 * n), 1, 1, 1, 1], dtype=np.uint8)
    if only is not None:
        return values, sizes
    samples = pixels[..., [1, 0, 2, 3]].ravel()  # green, red, blue, alpha
    return np.concatenate([values, canonical(lengths)[samples]]), np.concatenate([sizes, lengths[samples]])


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, how many) of a length."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    return 2 * extra + 2 + ((value - 1) >> extra & 1), (value - 1) & ((1 << extra) - 1), extra


def _run_fields(pixels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An image of runs of equal pixels: a literal each, and back-references to the pixel on the left."""
    literal, said = pixels.reshape(-1, 4)[starts], []
    for k, n in enumerate((lengths - 1).tolist()):
        while n:
            part = min(n, 4096)
            said.append((k, *_prefix(part)))
            n -= part
    copies = np.array(said, dtype=np.int64).reshape(-1, 4)
    green = code_lengths(np.bincount(np.concatenate([literal[:, 1], 256 + copies[:, 1]]), minlength=280))
    counts = np.bincount(literal[:, [0, 2, 3]].ravel(), minlength=256)
    rest = code_lengths(counts)
    only = int(np.argmax(counts)) if not rest.any() else None
    (v, n), (w, m) = _code_fields(green, None), _code_fields(rest, only)
    codes, others = canonical(green), canonical(rest)
    # fields: four a literal, two a reference (its length's code and extra bits; the distance is always the same and has no bits)
    at = np.concatenate([np.repeat(np.arange(len(literal)), 4), np.repeat(copies[:, 0], 2)])
    values = np.concatenate([np.stack([codes[literal[:, 1]], *(others[literal[:, c]] for c in (0, 2, 3))], axis=1).ravel(), np.stack([codes[256 + copies[:, 1]], copies[:, 2]], axis=1).ravel()])
    sizes = np.concatenate([np.stack([green[literal[:, 1]], *(rest[literal[:, c]] for c in (0, 2, 3))], axis=1).ravel(), np.stack([green[256 + copies[:, 1]], copies[:, 3]], axis=1).ravel()])
    order = np.argsort(at, kind="stable")
    head = [0, 0, *v, *(3 * w), 1, 0, 0, 1], [1, 1, *n, *(3 * m), 1, 1, 1, 1]
    return np.concatenate([np.array(head[0], dtype=np.uint16), values[order].astype(np.uint16)]), np.concatenate([np.array(head[1], dtype=np.uint8), sizes[order].astype(np.uint8)])


def left_residual(pixels: np.ndarray) -> np.ndarray:
    """Each pixel less the one on its left; less the one above in the first column, less opaque black at first."""
    out = pixels.copy()
    out[:, 1:] -= pixels[:, :-1]
    out[1:, 0] -= pixels[:-1, 0]
    out[0, 0] -= np.array([0, 0, 0, 255], dtype=np.uint8)
    return out


def _entropy(counts: np.ndarray) -> float:
    used = counts[counts > 0]
    return float(-(used * np.log2(used / used.sum())).sum())


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of a (height, width, RGBA) array: a palette for up to 16 colours, references where half of the pixels repeat the one on the
    left, the left predictor where it saves a tenth, else literals."""
    height, width, _ = pixels.shape
    values, sizes = [np.array([0x2F, width - 1, height - 1, 1, 0], dtype=np.uint16)], [np.array([8, 14, 14, 1, 3], dtype=np.uint8)]

    def add(v, n):
        values.append(np.asarray(v, dtype=np.uint16))
        sizes.append(np.asarray(n, dtype=np.uint8))

    flat = np.ascontiguousarray(pixels).reshape(-1, 4).view("<u4").ravel()
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    colours, index = np.unique(flat, return_inverse=True) if new.sum() <= len(flat) // 2 or len(flat) <= 64 else (flat, None)
    if index is not None and len(colours) <= 16:
        n = len(colours)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1
        table = colours.astype("<u4").view(np.uint8).reshape(1, n, 4)
        delta = table.copy()
        delta[:, 1:] -= table[:, :-1]
        add([1, PALETTE, n - 1], [1, 2, 8])
        add(*_literal_fields(delta, False))
        each, across = 8 >> pack, (width + (1 << pack) - 1) >> pack
        wide = np.zeros((height, across << pack), dtype=np.int64)
        wide[:, :width] = index.reshape(height, width)
        packed = (wide.reshape(height, across, 1 << pack) << (np.arange(1 << pack) * each)).sum(axis=2)
        image = np.zeros((height, across, 4), dtype=np.uint8)
        image[..., 1], image[..., 3] = packed, 255
        add([0], [1])
        add(*_literal_fields(image, True))
    elif new.sum() <= len(flat) // 2:
        starts = np.flatnonzero(new)
        add([0], [1])
        add(*_run_fields(pixels, starts, np.diff(np.append(starts, len(flat)))))
    else:
        residual = left_residual(pixels)
        if _entropy(np.bincount(residual.ravel(), minlength=256)) < 0.9 * _entropy(np.bincount(pixels.ravel(), minlength=256)):
            tile = 7  # blocks of 512 pixels, the largest
            modes = np.zeros(((height + 511) >> 9, (width + 511) >> 9, 4), dtype=np.uint8)
            modes[..., 1], modes[..., 3] = 1, 255
            add([1, PREDICTOR, tile], [1, 2, 3])
            add(*_literal_fields(modes, False))
            pixels = residual
        add([0], [1])
        add(*_literal_fields(pixels, True))
    return container(pack_bits(np.concatenate(values), np.concatenate(sizes)))


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW, 4)
    return b"".join(encode(rows[k : k + MOST]) for k in range(0, len(rows), MOST))


def read_back(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    images = decode(media)
    return b"".join(x.tobytes() for x in images), images


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        data, offsets = textnum.column_bytes(batch.column(1))
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = data[a:b].tobytes()
            media = store(text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text)))
            payload, images = read_back(media)
            total = sum(int(x.sum(dtype=np.int64)) for x in images)
            square = sum(int((x.astype(np.int64) ** 2).sum()) for x in images)
            mean = total / len(payload)
            feature = f"{len(images)}x{images[0].shape[1]}x{sum(x.shape[0] for x in images)} mean={mean:.4f} var={square / len(payload) - mean * mean:.4f}"
            rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])


def media_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    common.ship(df.sparkSession)
    texts = df.select("doc_id", common.text_or_empty().alias("text"))
    return texts.mapInArrow(
        _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, x in enumerate(decode(media) if media else []):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[0]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["id", "image", "width", "height", "rgba"])


def pixel_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """id, image, width, height, rgba: a row for each image of a column of WebP bytes."""
    common.ship(df.sparkSession)
    return df.selectExpr(f"cast({key} AS long) AS id", f"cast({media} AS binary) AS media").mapInArrow(_media, "id long, image int, width int, height int, rgba binary")


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(common.documents(spark, sf_dir))
