"""Lossless WebP (VP8L): writing, and reading back into pixel arrays.

The reader follows the public bitstream specification: prefix codes (simple and
normal, with meta prefix groups), back-references, colour cache, and the
inverse predictor, cross-colour, subtract-green and palette transforms.  Pixels
are uint32 ARGB arrays of shape (height, width).

``decode_many`` reads many images side by side: images with one group of codes
are decoded in lockstep, a pixel of each at a time, with numpy; all others one by
one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

#: Order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values: (x, y) of distance codes 1 to 120; a distance is x + y * width.
NEAR = """
0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3
2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1
2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7
7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
"""
NEAR_XY = [tuple(map(int, xy.split(","))) for xy in NEAR.split()]
#: Signature byte, the cache's multiplier, alphabets without the cache.
SIGNATURE, CACHE_FACTOR, LITERALS, LENGTHS, DISTANCES = 0x2F, 0x1E35A7BD, 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST = 11  # bits of a code that the writer makes


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > len(self.data) * 8:
            raise ValueError("the image ends too early")
        low = at >> 3
        return int.from_bytes(self.data[low : low + 5], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: tuple[list[int], int]) -> int:
        table, mask = code
        at = self.at
        low = at >> 3
        entry = table[int.from_bytes(self.data[low : low + 3], "little") >> (at & 7) & mask]
        self.at = at + (entry & 15)
        return entry >> 4


class Writer:
    def __init__(self):
        self.value = self.size = 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    """The numbers of ``width`` bits with their bits turned round."""
    out = np.zeros(1 << width, np.int64)
    for i in range(width):
        out |= (np.arange(1 << width) >> i & 1) << (width - 1 - i)
    return out


def canonical(lengths: Sequence[int]) -> np.ndarray:
    """The canonical code of each symbol, first bit lowest; 0 where there is none."""
    n = np.asarray(lengths, np.int64)
    used = np.flatnonzero(n)
    out = np.zeros(len(n), np.int64)
    if len(used):
        used = used[np.argsort(n[used], kind="stable")]
        width = int(n[used[-1]])
        room = 1 << (width - n[used])
        out[used] = _reversed(width)[np.cumsum(room) - room]
    return out


def reversed_codes(lengths: Sequence[int]) -> list[int]:
    return canonical(lengths).tolist()


@lru_cache(maxsize=256)
def lookup(lengths: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Table from the next bits to symbol << 4 | length, and its number of bits; one symbol alone takes no bits."""
    n = np.array(lengths, np.int64)
    used = np.flatnonzero(n)
    if len(used) < 2:
        return np.full(1, (int(used[0]) if len(used) else 0) << 4, np.uint32), 0
    used = used[np.argsort(n[used], kind="stable")]
    width = int(n[used[-1]])
    room = 1 << (width - n[used])
    if room.sum() != 1 << width:
        raise ValueError("the lengths are no prefix code")
    return np.repeat(used << 4 | n[used], room).astype(np.uint32)[_reversed(width)], width


def _scalar(code: tuple[np.ndarray, int]) -> tuple[list[int], int]:
    return code[0].tolist(), (1 << code[1]) - 1


#: Extra bits and least run of the symbols 16, 17 and 18 in a list of lengths.
_RUNS = ((2, 3), (3, 3), (7, 11))


def read_lengths(r: Reader, alphabet: int) -> list[int]:
    out = [0] * alphabet
    if r.bits(1):
        two = r.bits(1)
        out[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            out[r.bits(8)] = 1
        return out
    own = [0] * 19
    count = 4 + r.bits(4)
    ahead = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 8], "little") >> (r.at & 7)
    for place in LENGTH_ORDER[:count]:
        own[place] = ahead & 7
        ahead >>= 3
    r.bits(3 * count % 32)
    r.at += 3 * count - 3 * count % 32
    table, mask = _scalar(lookup(tuple(own)))
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    data, bit, number, at, before = r.data, r.at, int.from_bytes, 0, 8
    while at < alphabet and left:
        left -= 1
        low = bit >> 3
        ahead = number(data[low : low + 4], "little") >> (bit & 7)
        entry = table[ahead & mask]
        n, s = entry & 15, entry >> 4
        if s < 16:
            if s:
                out[at] = before = s
            bit += n
            at += 1
        else:
            more, least = _RUNS[s - 16]
            run = (ahead >> n & (1 << more) - 1) + least
            if at + run > alphabet:
                raise ValueError("too many lengths")
            if s == 16:
                out[at : at + run] = [before] * run
            bit += n + more
            at += run
    r.at = bit
    if bit > len(data) * 8:
        raise ValueError("the image ends too early")
    return out


def _value(r: Reader, prefix: int) -> int:
    """Length or distance of a prefix symbol."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.bits(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR_XY[code - 1]
    return max(1, x + y * width)


class Coded:
    """The head of an entropy-coded image: what is needed to decode its pixels."""

    def __init__(self, r: Reader, width: int, height: int, main: bool):
        self.width, self.height, self.reader = width, height, r
        self.cache_bits = r.bits(4) if r.bits(1) else 0
        self.meta, groups = None, 1
        if main and r.bits(1):
            self.meta_bits = r.bits(3) + 2
            image = Coded(r, -(-width >> self.meta_bits), -(-height >> self.meta_bits), False).decode()
            self.meta = (image >> np.uint32(8) & np.uint32(0xFFFF)).astype(int)
            groups = int(self.meta.max()) + 1
        cache = 1 << self.cache_bits if self.cache_bits else 0
        sizes = (LITERALS + LENGTHS + cache, LITERALS, LITERALS, LITERALS, DISTANCES)
        self.codes = [[lookup(tuple(read_lengths(r, n))) for n in sizes] for _ in range(groups)]

    def one_group(self) -> bool:
        return self.meta is None

    def decode(self) -> np.ndarray:
        r, width, n, shift = self.reader, self.width, self.width * self.height, 32 - self.cache_bits
        codes = [[_scalar(c) for c in group] for group in self.codes]
        cache = [0] * (1 << self.cache_bits) if self.cache_bits else None
        out: list[int] = []
        group = codes[0]
        while len(out) < n:
            at = len(out)
            if self.meta is not None:
                group = codes[self.meta[at // width >> self.meta_bits, at % width >> self.meta_bits]]
            s = r.symbol(group[0])
            if s < LITERALS:
                red = r.symbol(group[1])
                blue = r.symbol(group[2])
                out.append(r.symbol(group[3]) << 24 | red << 16 | s << 8 | blue)
            elif s < LITERALS + LENGTHS:
                length = _value(r, s - LITERALS)
                back = _distance(_value(r, r.symbol(group[4])), width)
                if back > at or at + length > n:
                    raise ValueError("a back-reference leaves the image")
                for i in range(at - back, at - back + length):
                    out.append(out[i])
            else:
                out.append(cache[s - LITERALS - LENGTHS])
            if cache is not None:
                for pixel in out[at:]:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        return np.array(out, np.uint32).reshape(self.height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 4) int64: alpha, red, green, blue."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """The prediction of one pixel, by channel, from its neighbours."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: min(255, max(0, x))
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(y - z) for y, z in zip(top, top_left))
        to_top = sum(abs(x - z) for x, z in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(left, top, top_left)]
    if mode == 13:
        return [clamp(m + int((m - z) / 2)) for m, z in zip(mean(left, top), top_left)]
    return [255, 0, 0, 0]


LEFT, TOP = 1, 2


def _predict_evenly(c: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """The same for ``LEFT`` or ``TOP`` in all blocks, by whole rows and columns; channels in, channels out."""
    out = c.copy()
    out[0, 0, 0] += -255 if forward else 255
    if forward:
        out[0, 1:] -= c[0, :-1]
        out[1:, 0] -= c[:-1, 0]
        out[1:, 1:] -= c[1:, :-1] if mode == LEFT else c[:-1, 1:]
    elif mode == LEFT:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        out = np.cumsum(out, axis=1)
    else:
        out[0] = np.cumsum(out[0], axis=0)
        out = np.cumsum(out, axis=0)
    return out


def _predict(data: np.ndarray, bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    c = _channels(data)
    if modes.min() == modes.max() and modes[0, 0] in (LEFT, TOP):
        return _pixels(_predict_evenly(c, int(modes[0, 0]), forward))
    height, width = data.shape
    known = c.tolist() if forward else [[None] * width for _ in range(height)]
    out = []
    for y in range(height):
        for x in range(width):
            if y == 0 or x == 0:
                p = [255, 0, 0, 0] if x == y == 0 else known[y][x - 1] if y == 0 else known[y - 1][x]
            else:
                right = known[y - 1][x + 1] if x + 1 < width else known[y][0]
                p = predicted(int(modes[y >> bits, x >> bits]), known[y][x - 1], known[y - 1][x], right, known[y - 1][x - 1])
            own = c[y, x].tolist()
            if forward:
                out.append([(a - b) & 255 for a, b in zip(own, p)])
            else:
                known[y][x] = [(a + b) & 255 for a, b in zip(own, p)]
    return _pixels(np.array(out if forward else known, np.int64).reshape(height, width, 4))


def _cross(data: np.ndarray, bits: int, factors: np.ndarray, forward: bool) -> np.ndarray:
    c = _channels(data)
    height, width = data.shape
    f = _channels(factors)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda x: ((x & 255) ^ 128) - 128
    delta = lambda t, v: signed(t) * signed(v) >> 5
    red, green, blue, sign = c[..., 1], c[..., 2], c[..., 3], -1 if forward else 1
    new_red = (red + sign * delta(f[..., 3], green)) & 255
    c[..., 3] = blue + sign * (delta(f[..., 2], green) + delta(f[..., 1], red if forward else new_red))
    c[..., 1] = new_red
    return _pixels(c)


def packing_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpacked(data: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    index = data >> np.uint32(8) & np.uint32(255)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = (index[:, :, None] >> shifts & np.uint32((1 << each) - 1)).reshape(data.shape[0], -1)[:, :width]
    return np.concatenate([table, np.zeros(256, np.uint32)])[index]


class Image:
    """A file with its head read: size, inverse transforms to apply, and the coded main image."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        size = int.from_bytes(data[16:20], "little")
        r = Reader(data[20 : 20 + size])
        if r.bits(8) != SIGNATURE:
            raise ValueError("no lossless WebP image")
        self.width, self.height = r.bits(14) + 1, r.bits(14) + 1
        r.bits(1)
        if r.bits(3):
            raise ValueError("unknown version")
        self.inverse: list[Callable[[np.ndarray], np.ndarray]] = []
        width = self.width
        while r.bits(1):
            kind = r.bits(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.bits(3) + 2
                image = Coded(r, -(-width >> bits), -(-self.height >> bits), False).decode()
                if kind == PREDICTOR:
                    self.inverse.append(lambda p, b=bits, m=image >> np.uint32(8) & np.uint32(15): _predict(p, b, m, False))
                else:
                    self.inverse.append(lambda p, b=bits, f=image: _cross(p, b, f, False))
            elif kind == SUBTRACT_GREEN:
                self.inverse.append(add_green)
            else:
                n = r.bits(8) + 1
                table = _pixels(np.cumsum(_channels(Coded(r, n, 1, False).decode()), axis=1))[0]
                bits = packing_bits(n)
                self.inverse.append(lambda p, w=width, b=bits, t=table: _unpacked(p, w, b, t))
                width = -(-width >> bits)
        self.coded = Coded(r, width, self.height, True)

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        for f in reversed(self.inverse):
            pixels = f(pixels)
        return pixels


def add_green(p: np.ndarray, sign: int = 1) -> np.ndarray:
    c = _channels(p)
    c[..., [1, 3]] += sign * c[..., 2:3]
    return _pixels(c)


def decode(data: bytes) -> np.ndarray:
    image = Image(data)
    return image.finish(image.coded.decode())


def _lockstep(images: list[Coded]) -> list[np.ndarray]:
    """Pixels of images with one group of codes: each step decodes one pixel, or copy, of every image that isn't done."""
    data = b"".join(c.reader.data for c in images)
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    sizes = np.array([c.width * c.height for c in images])
    stop = np.cumsum(sizes)
    begin, each = stop - sizes, np.arange(len(images))
    widths = [max(c.codes[0][k][1] for c in images) for k in range(4)]
    tables = [np.concatenate([np.tile(t, 1 << (width - w)) for t, w in (c.codes[0][k] for c in images)]).astype(np.int64) for k, width in enumerate(widths)]
    cache_bits = np.array([c.cache_bits for c in images])
    most = int(cache_bits.max())
    cache, shift = np.zeros(len(images) << most, np.uint32), (32 - cache_bits).astype(np.uint64)
    offset = np.cumsum([0, *(len(c.reader.data) for c in images[:-1])]) * 8
    bit = np.array([c.reader.at for c in images]) + offset
    lane, at, end, bases = each, begin.copy(), stop.copy(), [each << w for w in widths]
    out = np.zeros(stop[-1], np.uint32)

    def entries(k: int) -> np.ndarray:
        return tables[k][bases[k] + (window[bit >> 3] >> (bit & 7) & ((1 << widths[k]) - 1))]

    def remember(lanes: np.ndarray, pixels: np.ndarray) -> None:
        cache[(lanes << most) + ((pixels * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> shift[lanes]).astype(np.int64)] = pixels

    while len(lane):
        entry = entries(0)
        bit += entry & 15
        green = entry >> 4
        literal = green < LITERALS
        all_literal = bool(literal.all())
        pixel = green << 8
        for k, place in ((1, 16), (2, 0), (3, 24)):
            entry = entries(k)
            bit += entry & 15 if all_literal else (entry & 15) * literal
            pixel |= entry >> 4 << place
        step = 1
        if not all_literal:
            step = np.ones(len(lane), np.int64)
            known = np.flatnonzero(green >= LITERALS + LENGTHS)
            pixel[known] = cache[(lane[known] << most) + green[known] - LITERALS - LENGTHS]
            for i in np.flatnonzero(~literal & (green < LITERALS + LENGTHS)):
                image, first = images[lane[i]], int(at[i])
                r = image.reader
                r.at = int(bit[i] - offset[lane[i]])
                length = _value(r, int(green[i]) - LITERALS)
                back = _distance(_value(r, r.symbol(_scalar(image.codes[0][4]))), image.width)
                if back > first - begin[lane[i]] or first + length > end[i]:
                    raise ValueError("a back-reference leaves the image")
                copied = np.resize(out[first - back : first - back + min(back, length)], length)
                out[first : first + length] = copied
                if image.cache_bits:
                    remember(np.full(length, lane[i]), copied.astype(np.uint64))
                bit[i] = r.at + offset[lane[i]]
                pixel[i], step[i] = copied[0], length
            moved = step > 1
            if moved.any():
                pixel[moved] = out[at[moved] + step[moved] - 1]
            out[at + step - 1] = pixel
        else:
            out[at] = pixel
        if most:
            remember(lane, pixel.astype(np.uint64))
        at += step
        alive = at < end
        if not alive.all():
            lane, at, end, bit, bases = lane[alive], at[alive], end[alive], bit[alive], [b[alive] for b in bases]
    return [out[low:high].reshape(c.height, c.width) for c, low, high in zip(images, begin, stop)]


#: Images that are decoded side by side.
SIDE_BY_SIDE = 1024


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of each file."""
    images = [Image(f) for f in files]
    together = [i for i, x in enumerate(images) if x.coded.one_group()]
    pixels: list = [None] * len(images)
    # longest first, so that images of like size end together; a group has bounded tables
    together.sort(key=lambda i: -images[i].coded.width * images[i].coded.height)
    for low in range(0, len(together), SIDE_BY_SIDE):
        part = together[low : low + SIDE_BY_SIDE]
        for i, p in zip(part, _lockstep([images[i].coded for i in part])):
            pixels[i] = p
    return [x.finish(x.coded.decode() if p is None else p) for x, p in zip(images, pixels)]


def code_lengths(counts: Sequence[int], most: int = MOST) -> list[int]:
    """Lengths of a Huffman code for symbols with these counts, none over ``most``; one symbol alone has length 1."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    least = 1
    while True:
        heap = [(max(counts[s], least), i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        parent, new = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = new
            heapq.heapreplace(heap, (a[0] + b[0], new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            for i, s in enumerate(used):
                out[s] = depth[i]
            return out
        least = 2 * least + sum(counts) // 65536


#: The writer's own code for lengths: sixteen symbols of four bits.
_OWN = [4 if s <= 12 or s >= 16 else 0 for s in range(19)]
_OWN_CODES = reversed_codes(_OWN)


def write_lengths(w: Writer, lengths: Sequence[int]) -> None:
    w.bits(*bits_of_lengths(lengths))


def bits_of_lengths(lengths: Sequence[int]) -> tuple[int, int]:
    """The bits of a list of lengths, first bit lowest, and their number."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        acc, size = 1 | (len(used) - 1) << 1 | 1 << 2, 3
        for s in used:
            acc |= s << size
            size += 8
        return acc, size
    acc, size = 15 << 1, 5
    for place in LENGTH_ORDER:
        acc |= _OWN[place] << size
        size += 3
    size += 1

    def zeros(n: int) -> None:
        nonlocal acc, size
        while n:
            if n >= 11:
                run, value, bits = min(n, 138), _OWN_CODES[18] | (min(n, 138) - 11) << 4, 11
            elif n >= 3:
                run, value, bits = n, _OWN_CODES[17] | (n - 3) << 4, 7
            else:
                run, value, bits = 1, _OWN_CODES[0], 4
            acc |= value << size
            size += bits
            n -= run

    at = 0
    for s in used:
        zeros(s - at)
        acc |= _OWN_CODES[lengths[s]] << size
        size += 4
        at = s + 1
    zeros(len(lengths) - at)
    return acc, size


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits, and the bits, of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = (value - 1) >> (high - 1) & 1
    return 2 * high + second, high - 1, (value - 1) & ((1 << (high - 1)) - 1)


def write_image(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, search: bool = False) -> None:
    """One entropy-coded image with a single group of codes; with ``search``, back-references to equal pixels."""
    flat, width = pixels.ravel().tolist(), pixels.shape[1]
    tokens: list[tuple] = []
    cache, last, at = ([None] * (1 << cache_bits) if cache_bits else None), {}, 0
    while at < len(flat):
        start, length = at, 1
        back = at - last[key] if search and (key := tuple(flat[at : at + 3])) in last and len(key) == 3 else 0
        if back:
            while length < 4096 and at + length < len(flat) and flat[at + length] == flat[at + length - back]:
                length += 1
            codes = [i + 1 for i, (x, y) in enumerate(NEAR_XY) if max(1, x + y * width) == back]
            tokens.append(("copy", prefix(length), prefix(codes[0] if codes else back + 120)))
        else:
            slot = (CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append(("cache", slot) if cache_bits and cache[slot] == flat[at] else ("pixel", flat[at]))
        at += length
        for i in range(start, at):
            if cache_bits:
                cache[(CACHE_FACTOR * flat[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[i]
            last[tuple(flat[i : i + 3])] = i
    counts = [[0] * n for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    for kind, *x in tokens:
        if kind == "pixel":
            for c, shift in zip(counts, (8, 16, 0, 24)):
                c[x[0] >> shift & 255] += 1
        elif kind == "copy":
            counts[0][LITERALS + x[0][0]] += 1
            counts[4][x[1][0]] += 1
        else:
            counts[0][LITERALS + LENGTHS + x[0]] += 1
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    lengths = [code_lengths(c) for c in counts]
    for own in lengths:
        write_lengths(w, own)
    alone = [sum(map(bool, own)) < 2 for own in lengths]
    codes = [reversed_codes(own) for own in lengths]

    def put(k: int, s: int) -> None:
        if not alone[k]:
            w.bits(codes[k][s], lengths[k][s])

    for kind, *x in tokens:
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                put(k, x[0] >> shift & 255)
        elif kind == "copy":
            put(0, LITERALS + x[0][0])
            w.bits(x[0][2], x[0][1])
            put(4, x[1][0])
            w.bits(x[1][2], x[1][1])
        else:
            put(0, LITERALS + LENGTHS + x[0])


def head(w: Writer, width: int, height: int) -> None:
    w.bits(SIGNATURE, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)


def container(stream: bytes) -> bytes:
    even = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(even)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + even


def write_palette(w: Writer, colours: np.ndarray) -> None:
    w.bits(1, 1)
    w.bits(PALETTE, 2)
    w.bits(len(colours) - 1, 8)
    c = _channels(colours[None].astype(np.uint32))
    c[:, 1:] -= c[:, :-1].copy()
    write_image(w, _pixels(c), False)


def packed_index(index: np.ndarray, bits: int) -> np.ndarray:
    """(height, width) palette indices, 2**bits of them in each green value."""
    if not bits:
        return index
    each, per = 8 >> bits, 1 << bits
    pad = -index.shape[1] % per
    grouped = np.pad(index, ((0, 0), (0, pad))).reshape(index.shape[0], -1, per)
    return (grouped << (np.arange(per) * each)).sum(-1)


def encode(pixels: np.ndarray, transforms: Sequence[tuple] = (), cache_bits: int = 0, search: bool = True) -> bytes:
    """A file of any ARGB array. ``transforms``: (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, factors), (SUBTRACT_GREEN,) or (PALETTE,), in order."""
    w, data = Writer(), pixels.astype(np.uint32)
    head(w, data.shape[1], data.shape[0])
    for kind, *x in transforms:
        if kind == PALETTE:
            colours, index = np.unique(data, return_inverse=True)
            write_palette(w, colours)
            data = packed_index(index.reshape(data.shape), packing_bits(len(colours))).astype(np.uint32) << np.uint32(8)
            continue
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind == SUBTRACT_GREEN:
            data = add_green(data, -1)
        else:
            bits, image = x[0], np.asarray(x[1], np.uint32)
            w.bits(bits - 2, 3)
            write_image(w, image << np.uint32(8) if kind == PREDICTOR else image, False)
            data = _predict(data, bits, image, True) if kind == PREDICTOR else _cross(data, bits, image, True)
    w.bits(0, 1)
    write_image(w, data, True, cache_bits, search)
    return container(w.value.to_bytes(-(-w.size // 8), "little"))
