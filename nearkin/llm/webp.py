"""Lossless WebP (VP8L) in numpy: a reader of the whole format and a writer of grey strips.

Reader: `read_many` decodes many images side by side. Headers, prefix code lengths and transform data are parsed image
by image; the pixels of all images that have one group of prefix codes are then decoded in lockstep, one pixel of each
image at a time, with table look-ups over arrays: an image either reads a symbol or copies a pixel of its last back-reference.
Colour cache symbols, and the back-references of images with a colour cache, are followed image by image inside the same loop. Images with several groups of prefix codes, and the small images that carry transform data,
go through `_pixels`, symbol by symbol. Predictor, cross-colour, subtract-green and palette transforms are inverted on
the arrays.

Writer: `write_strips` stores rows of 8-bit samples as grey images of one prefix code group, with literals, back-references to
the nearest earlier place of the same five samples, and the subtract-green transform. `write` stores any ARGB image and takes transforms, a colour cache,
several code groups and back-references on demand; it is slower.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

# Fixed values of the format ------------------------------------------------------------------------------------------
#: Order in which the lengths of the code length code are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (columns to the left, rows up) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_NEAR = np.array([(0, 0), *NEAR], np.int64)
SIGNATURE, LENGTHS, DISTANCES, CACHE_FACTOR = 0x2F, 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_BITS = 15


# Bits ----------------------------------------------------------------------------------------------------------------
class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.limit = data, 0, len(data) * 8
        self.base, self.window = 0, int.from_bytes(data[:256], "little")

    def peek(self, n: int) -> int:
        at = self.at - self.base
        if at < 0 or at + n > 2048:
            self.base = self.at & ~7
            byte = self.base >> 3
            self.window = int.from_bytes(self.data[byte : byte + 256], "little")
            at = self.at - self.base
        return self.window >> at & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.limit:
            raise ValueError("the image ends early")
        return value


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def data(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _reversed(n: int) -> np.ndarray:
    """The n-bit numbers with their bits in reverse order."""
    out = np.zeros(1 << n, np.int64)
    for bit in range(n):
        out |= (np.arange(1 << n) >> bit & 1) << (n - 1 - bit)
    return out


_REVERSED = [_reversed(n) for n in range(MAX_BITS + 1)]


# Prefix codes --------------------------------------------------------------------------------------------------------
def code_tables(lengths: np.ndarray, bits: int) -> np.ndarray:
    """For each row of code lengths a table from the next `bits` bits to symbol * 16 + length. A row with one symbol reads
    no bits."""
    row, symbol = np.nonzero(lengths)
    length = lengths[row, symbol].astype(np.int64)
    count = np.bincount(row, minlength=len(lengths))
    length[count[row] == 1] = 0
    order = np.lexsort((symbol, length, row))
    row, symbol, length = row[order], symbol[order], length[order]
    span = 1 << (bits - length)
    whole = np.bincount(row, weights=span, minlength=len(lengths)).astype(np.int64)
    if (whole != 1 << bits).any():
        raise ValueError("a prefix code is not complete")
    table = np.repeat(symbol << 4 | length, span).astype(np.uint16).reshape(len(lengths), 1 << bits)
    return table[:, _REVERSED[bits]]


@lru_cache(maxsize=4096)
def _one_table(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    bits = max(lengths)
    return bits, code_tables(np.array([lengths]), bits)[0].tolist()


def _read_lengths(r: BitReader, size: int) -> np.ndarray:
    """Code lengths of one prefix code."""
    out = np.zeros(size, np.uint8)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        out[r.read(8 if wide else 1)] = 1
        if two:
            out[r.read(8)] = 1
        return out
    own = [0] * 19
    for i in range(4 + r.read(4)):
        own[CODE_LENGTH_ORDER[i]] = r.read(3)
    bits, table = _one_table(tuple(own))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        entry = table[r.peek(bits)]
        r.at += entry & 15
        code = entry >> 4
        if code < 16:
            out[at] = code
            at += 1
            last = code or last
        elif code == 16:
            n = 3 + r.read(2)
            out[at : at + n] = last
            at += n
        else:
            at += 3 + r.read(3) if code == 17 else 11 + r.read(7)
    if at > size or not out.any():
        raise ValueError("a prefix code is broken")
    return out


def _read_group(r: BitReader, cache: int) -> list[np.ndarray]:
    return [_read_lengths(r, n) for n in (256 + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)]


def _prefixed(r: BitReader, prefix: int) -> int:
    """A length or distance value."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + r.read(extra) + 1


def _distance(value: int, width: int) -> int:
    if value > 120:
        return value - 120
    x, y = NEAR[value - 1]
    return max(1, x + y * width)


def _cache_slot(argb, bits: int):
    return (argb * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - bits


def _symbol(r: BitReader, code: tuple[int, list[int]]) -> int:
    bits, table = code
    entry = table[r.peek(bits)]
    r.at += entry & 15
    return entry >> 4


def _pixels(r: BitReader, width: int, height: int, cache: int, groups: list[list[np.ndarray]], meta=None) -> np.ndarray:
    """Pixels of one image, symbol by symbol; meta: (bits, group numbers by block)."""
    codes = [[_one_table(tuple(c.tolist())) for c in g] for g in groups]
    out = [0] * (width * height)
    held = [0] * (1 << cache)
    at, n, own = 0, width * height, codes[0]
    while at < n:
        if meta:
            bits, numbers = meta
            own = codes[numbers[at // width >> bits, at % width >> bits]]
        s = _symbol(r, own[0])
        if s < 256:
            red, blue, alpha = (_symbol(r, own[i]) for i in (1, 2, 3))
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTHS:
            length = _prefixed(r, s - 256)
            back = _distance(_prefixed(r, _symbol(r, own[4])), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            new = [out[at - back + i % back] for i in range(length)]
        else:
            new = [held[s - 256 - LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache:
            for argb in new:
                held[_cache_slot(argb, cache)] = argb
    if r.at > r.limit:
        raise ValueError("the image ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _blocks(n: int, bits: int) -> int:
    return n + (1 << bits) - 1 >> bits


def _small(r: BitReader, width: int, height: int) -> np.ndarray:
    """An image that carries data of a transform or of prefix code groups."""
    cache = r.read(4) if r.read(1) else 0
    return _pixels(r, width, height, cache, [_read_group(r, cache)])


class Image:
    """An image's header, read up to its pixels."""

    def __init__(self, data: bytes):
        r = self.reader = BitReader(data)
        if r.read(8) != SIGNATURE:
            raise ValueError("not a lossless image")
        self.width, self.height = r.read(14) + 1, r.read(14) + 1
        r.read(1)
        if r.read(3):
            raise ValueError("an unknown version")
        self.transforms, self.packed = [], self.width
        while r.read(1):
            kind = r.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.read(3) + 2
                self.transforms.append((kind, self.packed, bits, _small(r, _blocks(self.packed, bits), _blocks(self.height, bits))))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, self.packed, 0, None))
            else:
                size = r.read(8) + 1
                bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                steps = _split(_small(r, size, 1)[0]).astype(np.int64)
                table = _joined((np.cumsum(steps, axis=0) & 255).astype(np.uint32))
                self.transforms.append((kind, self.packed, bits, table))
                self.packed = _blocks(self.packed, bits)
        self.cache = r.read(4) if r.read(1) else 0
        self.meta = None
        groups = 1
        if r.read(1):
            bits = r.read(3) + 2
            numbers = (_small(r, _blocks(self.packed, bits), _blocks(self.height, bits)) >> 8 & 0xFFFF).astype(np.int64)
            self.meta, groups = (bits, numbers), int(numbers.max()) + 1
        self.groups = [_read_group(r, self.cache) for _ in range(groups)]

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        """ARGB pixels from the decoded ones: transforms are inverted, the last first."""
        for kind, width, bits, data in reversed(self.transforms):
            pixels = _INVERSE[kind](pixels, width, bits, data)
        return pixels


# Transforms ----------------------------------------------------------------------------------------------------------
def _split(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue along a new last axis."""
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1)


def _joined(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predicted(mode: int, left, top, right, corner) -> list[int]:
    """Prediction of a pixel's four parts from its neighbours left, above, above right and above left."""
    half = lambda a, b: [x + y >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return list((left, top, right, corner)[mode - 1])
    if mode == 5:
        return half(half(left, right), top)
    if mode <= 9:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:  # of left and top the one nearer to left + top - corner
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(p - c) for p, c in zip(left, corner, strict=True))
        return list(left if to_left < to_top else top)
    if mode == 12:
        return [min(255, max(0, p + t - c)) for p, t, c in zip(left, top, corner, strict=True)]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(half(left, top), corner, strict=True)]


def neighbours(parts, x: int, y: int, width: int):
    """Left, top, top right and top left of a pixel that is neither in the first row nor column."""
    return parts[y][x - 1], parts[y - 1][x], parts[y - 1][x + 1] if x + 1 < width else parts[y][0], parts[y - 1][x - 1]


def _predict(parts, x: int, y: int, width: int, modes: np.ndarray, bits: int) -> list[int]:
    if not y:
        return parts[0][x - 1] if x else [255, 0, 0, 0]
    if not x:
        return parts[y - 1][0]
    return predicted(int(modes[y >> bits, x >> bits]) >> 8 & 15, *neighbours(parts, x, y, width))


def _unpredict(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    parts = _split(pixels).tolist()
    for y in range(len(parts)):
        for x in range(width):
            guess = _predict(parts, x, y, width, modes, bits)
            parts[y][x] = [a + b & 255 for a, b in zip(parts[y][x], guess, strict=True)]
    return _joined(np.array(parts))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int64)


def _factors(data: np.ndarray, shape: tuple[int, int], bits: int):
    """Green to red, green to blue and red to blue factors of each pixel."""
    data = data[np.ix_(np.arange(shape[0]) >> bits, np.arange(shape[1]) >> bits)]
    return _signed(data & 255), _signed(data >> 8 & 255), _signed(data >> 16 & 255)


def _uncross(pixels: np.ndarray, width: int, bits: int, data: np.ndarray) -> np.ndarray:
    p = _split(pixels).astype(np.int64)
    to_red, to_blue, red_to_blue = _factors(data, pixels.shape, bits)
    green = _signed(p[..., 2])
    p[..., 1] = p[..., 1] + (to_red * green >> 5) & 255
    p[..., 3] = p[..., 3] + (to_blue * green >> 5) + (red_to_blue * _signed(p[..., 1]) >> 5) & 255
    return _joined(p)


def _add_green(pixels: np.ndarray, width: int, bits: int, data) -> np.ndarray:
    green = pixels >> 8 & 255
    red_blue = (pixels & 0xFF00FF) + (green << 16 | green) & 0xFF00FF
    return pixels & np.uint32(0xFF00FF00) | red_blue


def _unpalette(pixels: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    x = np.arange(width)
    each = 8 >> bits
    index = (pixels >> 8 & 255)[:, x >> bits] >> each * (x & (1 << bits) - 1) & (1 << each) - 1
    return np.append(table, np.zeros(256, np.uint32))[index]


_INVERSE = {PREDICTOR: _unpredict, CROSS_COLOUR: _uncross, SUBTRACT_GREEN: _add_green, PALETTE: _unpalette}


# Decoding in lockstep ------------------------------------------------------------------------------------------------
def _lockstep(images: list[Image]) -> list[np.ndarray]:
    """Pixels of images with one group each, one symbol of each image at a time."""
    n = len(images)
    sizes = np.array([i.packed * i.height for i in images], np.int64)
    order = np.argsort(-sizes, kind="stable")
    images, sizes = [images[i] for i in order], sizes[order]
    # all data in one buffer, with the 32 bits that begin at each byte
    chunks = [i.reader.data for i in images]
    begin = np.cumsum([0, *map(len, chunks)])
    data = np.frombuffer(b"".join(chunks) + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    position = np.array([i.reader.at for i in images], np.int64) + begin[:-1] * 8

    def tables(which: int):
        width = max(len(i.groups[0][which]) for i in images)
        lengths = np.zeros((n, width), np.uint8)
        for row, image in enumerate(images):
            lengths[row, : len(image.groups[0][which])] = image.groups[0][which]
        bits = int(max(1, lengths.max()))
        return bits, code_tables(lengths, bits)

    bits, green = tables(0)
    others = [tables(i) for i in (1, 2, 3)]
    distance = tables(4)
    plain = all(((t & 15) == 0).all() for _, t in others)  # the other parts are the same all over an image
    rest = np.zeros(n, np.uint32)
    if plain:
        red, blue, alpha = (t[:, 0].astype(np.uint32) >> 4 for _, t in others)
        rest = alpha << 24 | red << 16 | blue
    caches = np.array([i.cache for i in images], np.int64)
    held = np.zeros((n, 1 << int(caches.max())), np.uint32) if caches.any() else None

    # A finished image reads on until all before it in the order have ended; a place behind each image takes what it reads.
    out = np.zeros(int((sizes + 1).sum()), np.uint32)
    base = np.cumsum(sizes + 1) - sizes - 1
    at, end = base.copy(), base + sizes
    flat, row = green.ravel(), np.arange(n) << bits
    mask = (1 << bits) - 1
    last = len(window) - 1
    widths = np.array([i.packed for i in images], np.int64)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def ahead(k, count):
        """The next `count` bits, 24 at most, of images k."""
        q = position[k]
        return (window[np.minimum(q >> 3, last)] >> (q & 7).astype(np.uint32)).astype(np.int64) & (1 << count) - 1

    def prefixed(k, prefix):
        """Length or distance values of images k."""
        extra = np.maximum(prefix - 2 >> 1, 0)
        value = np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + ahead(k, extra)) + 1
        position[k] += extra
        return value

    live = n
    copies = False
    while live:
        a, p = at[:live], position[:live]
        entry = flat[row[:live] + (window[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint32) & mask)]
        symbol = entry >> 4
        literal = symbol < 256
        copying = left[:live] > 0
        if copies:
            entry = np.where(copying, 0, entry)
            literal &= ~copying
        p += entry & 15
        simple = bool(literal.all())
        if plain:
            argb = symbol.astype(np.uint32) << 8 | rest[:live]
        else:
            argb = (symbol.astype(np.uint32) & 255) << 8
            for shift, (b, t) in zip((16, 0, 24), others, strict=True):
                e = t[np.arange(live), window[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint32) & (1 << b) - 1]
                p += np.where(literal, e & 15, 0)
                argb |= (e >> 4).astype(np.uint32) << shift
        if simple:
            out[a] = argb
        else:
            out[a[literal]] = argb[literal]
        if held is not None:
            rows = np.flatnonzero(literal & (caches[:live] > 0))
            held[rows, ((argb[rows] * np.uint32(CACHE_FACTOR)) >> (32 - caches[rows]).astype(np.uint32)).astype(np.int64)] = argb[rows]
        if not simple:
            other = ~literal & ~copying & (a < end[:live])
            new = np.flatnonzero(other & (symbol < 256 + LENGTHS) & (caches[:live] == 0))
            if len(new):
                left[new] = prefixed(new, symbol[new].astype(np.int64) - 256)
                code = distance[1][new, ahead(new, distance[0])].astype(np.int64)
                position[new] += code & 15
                value = prefixed(new, code >> 4)
                near = _NEAR[np.minimum(value, 120)]
                back[new] = np.where(value > 120, value - 120, np.maximum(near[:, 0] + near[:, 1] * widths[new], 1))
                if (back[new] > at[new] - base[new]).any() or (at[new] + left[new] > end[new]).any():
                    raise ValueError("a back-reference leaves the image")
                copying[new] = True
                other[new] = False
            k = np.flatnonzero(copying)
            out[a[k]] = out[a[k] - back[k]]
            left[k] -= 1
            a[k] += 1
            copies = len(k) > 0
        a += literal
        if not simple:
            for k in np.flatnonzero(other).tolist():
                _follow(images[k], k, int(symbol[k]), at, position, begin, out, base, end, distance, held)
        np.minimum(a, end[:live], out=a)
        while live and at[live - 1] >= end[live - 1]:
            live -= 1
    result: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for k, i in enumerate(order.tolist()):
        result[i] = out[base[k] : end[k]].reshape(images[k].height, images[k].packed)
    return result


def _follow(image: Image, k: int, symbol: int, at, position, begin, out, base, end, distance, held) -> None:
    """A back-reference or colour cache symbol of image k."""
    here = int(at[k])
    if symbol >= 256 + LENGTHS:
        new = held[k, symbol - 256 - LENGTHS : symbol - 255 - LENGTHS].copy()
    else:
        r = image.reader
        r.at = int(position[k]) - int(begin[k]) * 8
        length = _prefixed(r, symbol - 256)
        bits, table = distance
        entry = int(table[k, r.peek(bits)])
        r.at += entry & 15
        back = _distance(_prefixed(r, entry >> 4), image.packed)
        position[k] = r.at + int(begin[k]) * 8
        if back > here - base[k] or here + length > end[k]:
            raise ValueError("a back-reference leaves the image")
        new = np.resize(out[here - back : here], length) if back < length else out[here - back : here - back + length].copy()
    out[here : here + len(new)] = new
    at[k] = here + len(new)
    if image.cache:
        for argb in new.tolist():
            held[k, _cache_slot(argb, image.cache)] = argb


def read_many(chunks: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels (height x width, uint32) of VP8L chunks."""
    images = [Image(c) for c in chunks]
    alike = [k for k, i in enumerate(images) if i.meta is None]
    out: list[np.ndarray] = [None] * len(images)  # type: ignore[list-item]
    if alike:
        for k, pixels in zip(alike, _lockstep([images[k] for k in alike]), strict=True):
            out[k] = pixels
    for k, i in enumerate(images):
        if i.meta is not None:
            out[k] = _pixels(i.reader, i.packed, i.height, i.cache, i.groups, i.meta)
    return [i.finish(p) for i, p in zip(images, out, strict=True)]


# Files ---------------------------------------------------------------------------------------------------------------
def file_of(chunk: bytes) -> bytes:
    """A WebP file with one VP8L chunk."""
    pad = len(chunk) & 1
    return b"RIFF" + (12 + len(chunk) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + bytes(pad)


def chunks_of(data: bytes) -> list[bytes]:
    """The VP8L chunks of WebP files that stand one after another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a simple lossless WebP file")
        size = int.from_bytes(data[at + 16 : at + 20], "little")
        if at + 20 + size > len(data):
            raise ValueError("the file is cut short")
        out.append(data[at + 20 : at + 20 + size])
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return out


# Writing -------------------------------------------------------------------------------------------------------------
def huffman(counts: list[int], limit: int) -> list[int]:
    """Code lengths, at most `limit`, of symbols with these counts (at least two are over 0; 0: no code)."""
    used = [i for i, c in enumerate(counts) if c]
    least = 1
    while True:
        heap = [(max(counts[s], least), k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        new = len(used)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heap[0]
            above[x] = above[y] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * len(above)
        for k in range(len(above) - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[: len(used)]) <= limit:
            out = [0] * len(counts)
            for k, s in enumerate(used):
                out[s] = depth[k]
            return out
        least *= 2


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value of a length or distance."""
    x = value - 1
    if x < 4:
        return x, 0, 0
    high = x.bit_length() - 1
    extra = high - 1
    return 2 * high + (x >> extra & 1), extra, x & (1 << extra) - 1


#: Lengths of the code length code that is always written: 0 to 11, 17 and 18, of which 7 and 18 take three bits.
_OWN = [4] * 12 + [0] * 5 + [4, 3]
_OWN[7] = 3
STRIP_BITS = 11


@lru_cache(maxsize=1)
def _own_codes() -> tuple[list[tuple[int, int]], int, int]:
    """(code, bits) of each code length symbol, and the bits that store this code."""
    start, codes = 0, [(0, 0)] * 19
    for n, s in sorted((n, s) for s, n in enumerate(_OWN) if n):
        codes[s] = (int(_REVERSED[4][start]), n)
        start += 1 << (4 - n)
    w = BitWriter()
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(_OWN[s], 3)
    w.put(0, 1)
    return codes, w.value, w.n


def _put_lengths(w: BitWriter, lengths: list[int]) -> None:
    """Stores a prefix code of lengths up to 11."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        symbol = used[0] if used else 0
        wide = symbol > 1
        w.put(1 | wide << 2, 3)
        w.put(symbol, 8 if wide else 1)
        return
    codes, head, n = _own_codes()
    value, bits = head, n
    last = -1
    for i in [*used, len(lengths)]:
        gap = i - last - 1
        while gap:
            if gap >= 11:
                run = min(gap, 138)
                c, b = codes[18]
                value |= (c | (run - 11) << b) << bits
                bits += b + 7
            elif gap >= 3:
                run = min(gap, 10)
                c, b = codes[17]
                value |= (c | (run - 3) << b) << bits
                bits += b + 3
            else:
                run = 1
                value |= codes[0][0] << bits
                bits += codes[0][1]
            gap -= run
        if i < len(lengths):
            c, b = codes[lengths[i]]
            value |= c << bits
            bits += b
        last = i
    w.put(value, bits)


def _codes(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Codes to write, first bit lowest, for each row of lengths; rows with one symbol take no bits."""
    row, symbol = np.nonzero(lengths)
    length = lengths[row, symbol].astype(np.int64)
    order = np.lexsort((symbol, length, row))
    row, symbol, length = row[order], symbol[order], length[order]
    span = 1 << (bits - length)
    total = np.cumsum(span) - span
    first = np.searchsorted(row, np.arange(len(lengths)))
    start = total - np.append(total, 0)[np.minimum(first, len(total) - 1)][row]
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = _REVERSED[bits][start & (1 << bits) - 1]
    return out


#: Samples that are matched at once, samples that must be equal, the least and the greatest length of a back-reference.
PIECE, EQUAL, COPY_LEAST, COPY_MOST = 1 << 20, 5, 7, 4096


def _prefixes_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_prefix_of` of many values."""
    x = value - 1
    high = np.frexp(np.maximum(x, 1).astype(float))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    return np.where(x < 4, x, 2 * high + (x >> extra & 1)), np.where(x < 4, 0, extra), np.where(x < 4, 0, x & (1 << extra) - 1)


def _copies(samples: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the back-references, in order, that follow one another from the left in each stretch. A place may
    be copied from the nearest earlier one with the same EQUAL samples, as far as the places behind it have the same distance."""
    edges = np.unique(np.concatenate([begin, *[np.arange(a, b, PIECE) for a, b in zip(begin, begin[1:], strict=False) if b - a > PIECE]]))
    found, first = [], 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE, "right")) - 1)
        origin, n = int(edges[first]), int(edges[last] - edges[first])
        start, stop = edges[first:last] - origin, edges[first + 1 : last + 1] - origin
        first = last
        if n < EQUAL:
            continue
        x = samples[origin : origin + n].astype(np.uint64)
        gram = x[: n - EQUAL + 1].copy()
        for i in range(1, EQUAL):
            gram |= x[i : n - EQUAL + 1 + i] << np.uint64(8 * i)
        key = np.sort(gram << np.uint64(24) | np.arange(len(gram), dtype=np.uint64))
        same = key[1:] >> np.uint64(24) == key[:-1] >> np.uint64(24)
        place = (key & np.uint64(0xFFFFFF)).astype(np.int32)
        distance = np.zeros(n + 1, np.int32)
        distance[place[1:][same]] = np.diff(place)[same]
        here = np.arange(n + 1, dtype=np.int32)
        size = stop - start
        low, high = np.append(np.repeat(start, size), n), np.append(np.repeat(stop, size), n)
        distance[(here - distance < low) | (here + EQUAL > high)] = 0
        ends = np.append(distance[1:] != distance[:-1], True)
        run = np.minimum.accumulate(np.where(ends, here, n)[::-1])[::-1]
        length = np.where(distance > 0, np.minimum(run - here + EQUAL, COPY_MOST), 0)
        following = np.minimum.accumulate(np.where(length >= COPY_LEAST, here, n)[::-1])[::-1]
        taken = []
        while len(start):
            c = following[start]
            go = c < stop
            c, stop = c[go], stop[go]
            taken.append(c)
            start = c + length[c]
        c = np.sort(np.concatenate(taken))
        found.append((c + origin, length[c], distance[c]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(f).astype(np.int64) for f in zip(*found, strict=True))


def write_strips(samples: np.ndarray, begin: np.ndarray, width: int) -> list[bytes]:
    """A WebP file for each stretch begin[i]:begin[i+1] of 8-bit samples, a multiple of `width` long, as a grey image."""
    n = len(begin) - 1
    size = np.diff(begin)
    place, length, distance = _copies(samples, begin)
    # each symbol's place: literals have one entry, back-references one for the length and one for the distance
    covered = np.zeros(len(samples) + 1, np.int8)
    covered[place] += 1
    covered[place + length] -= 1
    single = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
    near = np.full(8 * width + 9, 0, np.int64)
    for code, (x, y) in reversed(list(enumerate(NEAR, 1))):
        near[max(1, x + y * width)] = code
    short = near[np.minimum(distance, len(near) - 1)] * (distance < len(near))
    long_symbol, long_bits, long_rest = _prefixes_of(length)
    far_symbol, far_bits, far_rest = _prefixes_of(np.where(short > 0, short, distance + 120))
    places = np.concatenate([single, place, place])
    order = np.argsort(places, kind="stable")
    lane = np.repeat(np.arange(n), np.diff(np.searchsorted(places[order], begin)))
    value = np.concatenate([samples[single].astype(np.int64), 256 + long_symbol, 256 + LENGTHS + far_symbol])[order]
    bits = np.concatenate([np.zeros(len(single), np.int64), long_bits, far_bits])[order]
    rest = np.concatenate([np.zeros(len(single), np.int64), long_rest, far_rest])[order]
    alphabet = 256 + LENGTHS
    both = alphabet + DISTANCES
    counts = np.bincount(lane * both + value, minlength=n * both).reshape(n, both)
    lengths = np.zeros((n, both), np.int64)
    heads: list[BitWriter] = []

    def code_of(row: list[int]) -> tuple[list[int], bool]:
        some = sum(map(bool, row)) > 1
        return huffman(row, STRIP_BITS) if some else [int(bool(c)) for c in row], some

    for k in range(n):
        row = counts[k].tolist()
        (own, some), (far, more) = code_of(row[:alphabet]), code_of(row[alphabet:])
        w = BitWriter()
        w.put(SIGNATURE, 8)
        w.put(width - 1, 14)
        w.put(int(size[k]) // width - 1, 14)
        w.put(0, 4)
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        w.put(0, 3)  # no further transform, no colour cache, one group
        _put_lengths(w, own)
        w.put(0b0001, 4)  # red: always 0
        w.put(0b0001, 4)  # blue: always 0
        w.put(255 << 3 | 0b101, 11)  # alpha: always 255
        _put_lengths(w, far)
        heads.append(w)
        if some:
            lengths[k, :alphabet] = own
        if more:
            lengths[k, alphabet:] = far
    codes = np.concatenate([_codes(lengths[:, :alphabet], STRIP_BITS), _codes(lengths[:, alphabet:], STRIP_BITS)], axis=1)
    taken = lengths[lane, value]
    code, bits = codes[lane, value] | rest << taken, taken + bits
    head = np.array([w.n for w in heads], np.int64)
    total = head + np.bincount(lane, weights=bits, minlength=n).astype(np.int64)
    byte_size = total + 7 >> 3
    base = np.cumsum(byte_size) - byte_size
    before = np.cumsum(bits) - bits
    first = np.searchsorted(lane, np.arange(n))
    offset = (base * 8 + head)[lane] + before - before[first][lane]
    out = _pack(code, bits, offset, int(byte_size.sum()))
    files = []
    for k, w in enumerate(heads):
        body = out[base[k] : base[k] + byte_size[k]]
        start = np.frombuffer(w.data(), np.uint8)
        body[: len(start)] |= start
        files.append(file_of(body.tobytes()))
    return files


def _pack(code: np.ndarray, bits: np.ndarray, offset: np.ndarray, size: int) -> np.ndarray:
    """Bytes with each code at its bit; the bits don't overlap and the offsets ascend."""
    keep = bits > 0
    code, offset = code[keep].astype(np.uint64), offset[keep]
    words = np.zeros(size // 4 + 3, np.uint64)
    if len(code):
        word = offset >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        part = np.add.reduceat(code << (offset & 31).astype(np.uint64), first)
        at = word[first]
        words[at] |= part & np.uint64(0xFFFFFFFF)
        words[at + 1] |= part >> np.uint64(32)
    return words.astype("<u4").view(np.uint8)[:size]


def write(argb: np.ndarray, transforms: tuple[int, ...] = (), bits: int = 3, mode: int = 11, factors: tuple[int, int, int] = (11, 250, 3), cache: int = 0, group_bits: int = 0, references: bool = True) -> bytes:
    """A WebP file of any ARGB image. transforms are applied in the order given, predictor and cross-colour with one mode
    and one set of factors for all blocks; group_bits: prefix code groups by rows of blocks of that many bits, two in turn."""
    height, width = argb.shape
    w = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    pixels = argb.astype(np.uint32)
    for kind in transforms:
        w.put(1 | kind << 1, 3)
        here = pixels.shape[1]
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(bits - 2, 3)
            value = mode << 8 if kind == PREDICTOR else factors[2] << 16 | factors[1] << 8 | factors[0]
            data = np.full((_blocks(height, bits), _blocks(here, bits)), value, np.uint32)
            _put_image(w, data, 0, 0, False, main=False)
        if kind == PREDICTOR:
            parts = _split(pixels).tolist()
            left = [[[a - b & 255 for a, b in zip(parts[y][x], _predict(parts, x, y, here, data, bits), strict=True)] for x in range(here)] for y in range(height)]
            pixels = _joined(np.array(left))
        elif kind == CROSS_COLOUR:
            p = _split(pixels).astype(np.int64)
            to_red, to_blue, red_to_blue = _factors(data, pixels.shape, bits)
            green, red = _signed(p[..., 2]), _signed(p[..., 1])
            p[..., 1] = p[..., 1] - (to_red * green >> 5) & 255
            p[..., 3] = p[..., 3] - (to_blue * green >> 5) - (red_to_blue * red >> 5) & 255
            pixels = _joined(p)
        elif kind == SUBTRACT_GREEN:
            p = _split(pixels).astype(np.int64)
            p[..., 1], p[..., 3] = p[..., 1] - p[..., 2] & 255, p[..., 3] - p[..., 2] & 255
            pixels = _joined(p)
        else:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(table) - 1, 8)
            steps = np.diff(_split(table).astype(np.int64), axis=0, prepend=0) & 255
            _put_image(w, _joined(steps)[None, :], 0, 0, False, main=False)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = index.reshape(pixels.shape)
            bundled = np.zeros((height, _blocks(here, pack)), np.uint32)
            for x in range(here):
                bundled[:, x >> pack] |= (index[:, x] << (8 >> pack) * (x & (1 << pack) - 1)).astype(np.uint32)
            pixels = np.uint32(0xFF000000) | bundled << 8
    w.put(0, 1)
    _put_image(w, pixels, cache, group_bits, references, main=True)
    return file_of(w.data())


def _put_image(w: BitWriter, pixels: np.ndarray, cache: int, group_bits: int, references: bool, main: bool) -> None:
    """An entropy-coded image."""
    height, width = pixels.shape
    w.put(bool(cache), 1)
    if cache:
        w.put(cache, 4)
    numbers = None
    if main:
        w.put(bool(group_bits), 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            numbers = np.zeros((_blocks(height, group_bits), _blocks(width, group_bits)), np.uint32)
            numbers[1::2] = 1
            _put_image(w, numbers << 8, 0, 0, False, main=False)
    flat = pixels.ravel().tolist()
    held, seen, tokens, at = [None] * (1 << cache), {}, [], 0
    while at < len(flat):
        key = tuple(flat[at : at + 3])
        back = at - seen[key] if references and key in seen else 0
        group = int(numbers[at // width >> group_bits, at % width >> group_bits]) if numbers is not None else 0
        length = 1
        if back:
            while at + length < len(flat) and length < 4096 and flat[at + length] == flat[at + length - back]:
                length += 1
            code = next((i for i, (x, y) in enumerate(NEAR, 1) if max(1, x + y * width) == back), back + 120)
            tokens.append((group, [(0, 256 + (p := _prefix_of(length))[0], *p[1:]), (4, (q := _prefix_of(code))[0], *q[1:])]))
        elif cache and held[_cache_slot(flat[at], cache)] == flat[at]:
            tokens.append((group, [(0, 256 + LENGTHS + _cache_slot(flat[at], cache), 0, 0)]))
        else:
            c = flat[at]
            tokens.append((group, [(0, c >> 8 & 255, 0, 0), (1, c >> 16 & 255, 0, 0), (2, c & 255, 0, 0), (3, c >> 24, 0, 0)]))
        for k in range(at, at + length):
            seen[tuple(flat[k : k + 3])] = k
            if cache:
                held[_cache_slot(flat[k], cache)] = flat[k]
        at += length
    sizes = (256 + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    codes = []
    for g in range(1 if numbers is None else int(numbers.max()) + 1):
        for which, size in enumerate(sizes):
            counts = [0] * size
            for group, parts in tokens:
                for kind, symbol, _, _ in parts:
                    if group == g and kind == which:
                        counts[symbol] += 1
            used = [i for i, c in enumerate(counts) if c]
            if len(used) == 1 and used[0] > 255:
                counts[0] = 1  # one symbol alone is stored only up to 255
                used = [0, *used]
            lengths = huffman(counts, STRIP_BITS) if len(used) > 1 else [int(bool(c)) for c in counts]
            _put_lengths(w, lengths)
            codes.append((lengths if len(used) > 1 else [0] * size, _codes(np.array([lengths]), STRIP_BITS)[0]))
    for group, parts in tokens:
        for kind, symbol, extra, rest in parts:
            lengths, values = codes[group * 5 + kind]
            w.put(int(values[symbol]) if lengths[symbol] else 0, lengths[symbol])
            w.put(rest, extra)
