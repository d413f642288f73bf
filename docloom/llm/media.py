"""Media columns: payloads as lossless WebP images, read back into pixels and features.

A payload's bytes are the samples of images, four to a pixel (blue, green, red,
alpha), 16 pixels wide and up to 256 high, one file after the other; so a very
long text is many small images.  What an image uses follows from its content, where
it is estimated to save bits: a predictor (left or top), a cross-colour factor, a
palette of up to 256 colours, a colour cache; rows that repeat an earlier row are
back-references.

Null and empty texts are 64 zero bytes.  Equal texts give equal files.  An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import webp
from docloom.llm.common import bounded, small_batches, utf8

#: Bytes of a row and of an image, pixels of a row.
ROW, TILE, ACROSS = 64, 64 * 256, 16
#: Bits of the colour cache, where there is one, and hits from which it pays.
CACHE_BITS, HITS = 7, 100
#: Share of the plain cost that a transform must save, and factors of the cross-colour transform that are tried.
SAVING, FACTORS = 0.1, (16, 32)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % ROW if data else ROW)


def _copies(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows (of ROW bytes) equal to rows a fixed distance before, in one document: first row, rows, distance in rows."""
    rows = data.reshape(-1, ROW)
    words = rows.view(np.uint64)
    key = (words * (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1, dtype=np.uint64)
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    by = np.lexsort((np.arange(len(key)), key, doc))
    same = (key[by[1:]] == key[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
    at, source = by[1:][same], by[:-1][same]
    equal = (words[at] == words[source]).all(1)
    at, source = at[equal], source[equal]
    order = np.argsort(at)
    at, back = at[order], (at - source)[order]
    if not len(at):
        return at, at, back
    begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (back[1:] != back[:-1]) | (doc[at[1:]] != doc[at[:-1]])])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(at)))
    # a copy has 4096 pixels at most
    most = 4096 // ACROSS
    pieces = -(-count // most)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(at[first], pieces) + k * most, np.minimum(np.repeat(count, pieces) - k * most, most), np.repeat(back[first], pieces)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The WebP files of each payload (a positive multiple of ROW bytes), one after the other."""
    tiles = [-(-len(p) // TILE) for p in payloads]
    files = encode_tiles([p[i : i + TILE] for p in payloads for i in range(0, len(p), TILE)])
    ends = np.cumsum(tiles).tolist()
    return [b"".join(files[e - n : e]) for e, n in zip(ends, tiles)]


def tiles_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    """Pixels of each payload, the tiles below one another."""
    parts = [tiles_of(m) for m in media]
    pixels = webp.decode_many([f for own in parts for f in own])
    ends = np.cumsum(list(map(len, parts))).tolist()
    return [np.concatenate(pixels[e - len(own) : e]) for e, own in zip(ends, parts)]


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits of each row's symbols by their entropy."""
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _cost(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Bits of each document's values (bytes)."""
    return _bits(np.bincount(doc << 8 | values.ravel() & 255, minlength=256 * n).reshape(n, 256))


def _transformed(tiles: list[bytes], writers: list[webp.Writer]) -> tuple[list[np.ndarray], np.ndarray]:
    """The images to code, one for each tile, after the transforms that pay; these are written.  And which are of one colour."""
    n, sizes = len(tiles), np.array([len(t) // 4 for t in tiles])
    pixels = np.frombuffer(b"".join(tiles), "<u4")
    doc = np.repeat(np.arange(n), sizes)
    rows = np.repeat(np.arange(n), sizes // ACROSS)
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    alpha, red, green, blue = ((pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64).reshape(-1, ACROSS) for s in (24, 16, 8, 0))
    by_channel = [_cost(x, doc, n) for x in (alpha, red, green, blue)]
    # what left and top leave of green, as the transform has it: the first column by the pixel above, the first row by the one before
    above, before = np.roll(green, 1, axis=0), np.roll(green, 1, axis=1)
    above[first] = 0
    left, top = green - before, green - above
    left[:, 0], top[first] = green[:, 0] - above[:, 0], left[first]
    left[first, 0], top[first, 0] = green[first, 0], green[first, 0]
    by_left, by_top, enough = _cost(left, doc, n), _cost(top, doc, n), (1 - SAVING) * by_channel[2]
    mode = np.where((by_left <= by_top) & (by_left < enough), webp.LEFT, np.where(by_top < enough, webp.TOP, 0))
    # red and blue less a multiple of green
    signed, factor = (green ^ 128) - 128, np.zeros((2, n), np.int64)
    for k, (channel, own) in enumerate(((red, by_channel[1]), (blue, by_channel[3]))):
        best = (1 - SAVING) * own
        for f in FACTORS:
            less = _cost(channel - (f * signed >> 5), doc, n)
            factor[k], best = np.where(less < best, f, factor[k]), np.minimum(less, best)
    key = np.sort(doc.astype(np.uint64) << np.uint64(32) | pixels)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner, runs = (key[new] >> np.uint64(32)).astype(np.int64), np.diff(np.append(new, len(key)))
    colours = np.bincount(owner, minlength=n)
    # a palette's own colours cost about 32 bits each, an index as much as its entropy
    index_cost = sizes * np.log2(np.maximum(sizes, 1)) - np.bincount(owner, runs * np.log2(runs), minlength=n)
    palette = (colours <= 256) & (index_cost + 32 * colours < (1 - SAVING) * np.minimum(sum(by_channel), 4 * np.minimum(by_left, by_top)))
    out, ends = [], np.cumsum(sizes)
    for i, (w, low, high) in enumerate(zip(writers, (ends - sizes).tolist(), ends.tolist())):
        own = pixels[low:high].reshape(-1, ACROSS).astype(np.uint32)
        if palette[i]:
            values, index = np.unique(own, return_inverse=True)
            webp.write_palette(w, values)
            own = webp.packed_index(index.reshape(own.shape), webp.packing_bits(len(values))).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
        elif mode[i]:
            w.bits(1 | webp.PREDICTOR << 1 | 7 << 3, 6)  # one block
            webp.write_image(w, np.full((1, 1), int(mode[i]) << 8, np.uint32), False)
            own = webp._pixels(webp._predict_evenly(webp._channels(own), int(mode[i]), True))
        elif factor[:, i].any():
            w.bits(1 | webp.CROSS_COLOUR << 1 | 7 << 3, 6)
            factors = np.full((1, 1), (int(factor[1, i]) & 255) << 8 | int(factor[0, i]) & 255, np.uint32)
            webp.write_image(w, factors, False)
            own = webp._cross(own, 9, factors, True)
        w.bits(0, 1)
        out.append(own)
    return out, colours == 1


def _cache_hits(pixels: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each pixel in its image's colour cache, and whether the cache has it there when it comes."""
    slot = ((pixels.astype(np.uint64) * np.uint64(webp.CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    key = doc << CACHE_BITS | slot
    by = np.argsort(key, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (pixels[by[1:]] == pixels[by[:-1]])
    return slot, hit


def encode_tiles(tiles: list[bytes]) -> list[bytes]:
    writers = [webp.Writer() for _ in tiles]
    for w, data in zip(writers, tiles):
        webp.head(w, ACROSS, len(data) // ROW)
    images, even = _transformed(tiles, writers)
    n, sizes = len(images), np.array([x.size for x in images])
    pixels, doc = np.concatenate([x.ravel() for x in images]), np.repeat(np.arange(n), sizes)
    begin = np.cumsum(sizes) - sizes
    token = np.ones(len(pixels), bool)
    far: dict[int, list[tuple[int, tuple, tuple]]] = {}
    # rows of packed images are shorter, and those of one colour take no bits; they are coded without copies
    plain = np.repeat(np.array([x.shape[1] == ACROSS for x in images]) & ~even, sizes)
    if plain.any():
        places = np.flatnonzero(plain)[::ACROSS]
        for first, count, back in zip(*_copies(pixels[plain].view(np.uint8), doc[plain][::ACROSS])):
            at, length = int(places[first]), int(count) * ACROSS
            token[at + 1 : at + length] = False
            far.setdefault(int(doc[at]), []).append((at, webp.prefix(length), webp.prefix(int(back) * ACROSS + 120)))
    copy = np.array([x[0] for own in far.values() for x in own], np.int64)
    literal = token.copy()
    literal[copy] = False
    slot, hit = _cache_hits(pixels, doc)
    hit &= literal
    cached = (np.bincount(doc[hit], minlength=n) >= HITS) & ~even
    hit &= cached[doc]
    literal &= ~hit
    for w, has in zip(writers, cached.tolist()):
        w.bits(1 | CACHE_BITS << 1 if has else 0, 5 if has else 1)
        w.bits(0, 1)  # one group of codes
    extra, extra_bits = np.zeros(len(pixels), np.uint64), np.zeros(len(pixels), np.int64)
    alphabet = webp.LITERALS + webp.LENGTHS
    symbol = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    symbol[hit] = alphabet + slot[hit]
    for own in far.values():
        for at, length, _ in own:
            symbol[at] = webp.LITERALS + length[0]
    whole = alphabet + (1 << CACHE_BITS)
    at = np.flatnonzero(token)
    lit = np.flatnonzero(literal)
    channels = [(symbol, at, whole), *(((pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64), lit, 256) for s in (16, 0, 24))]
    counts = [np.bincount(doc[where] * size + x[where], minlength=size * n).reshape(n, size) for x, where, size in channels]
    codes, widths = ([np.zeros((n, size), kind) for _, _, size in channels] for kind in (np.uint64, np.int64))
    # red, blue and alpha share a code where that costs little, as in prose
    together = counts[1] + counts[2] + counts[3]
    alike = _bits(together) <= 1.05 * sum(map(_bits, counts[1:]))
    for d, w in enumerate(writers):
        for k, own_counts in enumerate((counts[0][d] if cached[d] else counts[0][d, :alphabet], *((together[d],) if alike[d] else (c[d] for c in counts[1:])))):
            own = webp.code_lengths(own_counts.tolist())
            coded = webp.bits_of_lengths(own)
            for channel in (1, 2, 3) if k and alike[d] else (k,):
                w.bits(*coded)
                if sum(map(bool, own)) > 1:
                    codes[channel][d, : len(own)], widths[channel][d, : len(own)] = webp.canonical(own), own
        distances = [0] * webp.DISTANCES
        for _, _, x in far.get(d, ()):
            distances[x[0]] += 1
        of_distance = webp.code_lengths(distances)
        webp.write_lengths(w, of_distance)
        alone, code = sum(map(bool, of_distance)) < 2, webp.reversed_codes(of_distance)
        for place, length, distance in far.get(d, ()):
            own_bits = 0 if alone else of_distance[distance[0]]
            extra[place] = length[2] | (0 if alone else code[distance[0]]) << length[1] | distance[2] << (length[1] + own_bits)
            extra_bits[place] = length[1] + own_bits + distance[1]
    # a token's bits: its first code, then three more codes or a copy's fields; all 64 at most
    value, bits = codes[0][doc, symbol], widths[0][doc, symbol]
    for (x, where, _), code, width in zip(channels[1:], codes[1:], widths[1:]):
        value[where] |= code[doc[where], x[where]] << bits[where].astype(np.uint64)
        bits[where] += width[doc[where], x[where]]
    value[copy] |= extra[copy] << bits[copy].astype(np.uint64)
    bits[copy] += extra_bits[copy]
    value, bits, owner = value[at], bits[at], doc[at]
    ends = np.cumsum(bits)
    before = np.concatenate([[0], ends])[np.searchsorted(at, begin)]  # bits of earlier documents
    heads = np.array([w.size for w in writers])
    body = np.bincount(owner, bits, minlength=n).astype(np.int64)
    length = -(-(heads + body) // 8)
    room = -(-length // 4) * 4 + 8
    base = (np.cumsum(room) - room) * 8
    place = ends - bits + (base + heads - before)[owner]
    # fields of up to 32 bits
    fields = [(place, value & np.uint64(0xFFFFFFFF)), (place + 32, value >> np.uint64(32))]
    top = [(int(b) + 32 * k, w.value >> (32 * k) & 0xFFFFFFFF) for b, w in zip(base, writers) for k in range(-(-w.size // 32))]
    fields.append((np.array([t[0] for t in top]), np.array([t[1] for t in top], np.uint64)))
    words = np.zeros(int(room.sum()) // 4 + 2)
    for where, what in fields:
        used = np.flatnonzero(what)
        shifted = what[used] << (where[used] & 31).astype(np.uint64)
        words += np.bincount(where[used] >> 5, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))[: len(words)]
        high = np.flatnonzero(shifted >> np.uint64(32))
        words += np.bincount((where[used[high]] >> 5) + 1, (shifted[high] >> np.uint64(32)).astype(np.float64), minlength=len(words))[: len(words)]
    stream = words.astype("<u4").tobytes()
    return [webp.container(stream[b // 8 : b // 8 + k]) for b, k in zip(base.tolist(), length.tolist())]


def payload_of(pixels: np.ndarray, size: int) -> bytes:
    return pixels.astype("<u4").tobytes()[:size]


def feature(pixels: np.ndarray) -> str:
    """Mean, distinct values and entropy of the samples, and a hash of which eighths of the image are brighter than the mean."""
    samples = np.frombuffer(pixels.astype("<u4").tobytes(), np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    total = int(np.dot(counts, np.arange(256)))
    edges = np.arange(8) * len(samples) // 8
    sums, sizes = np.add.reduceat(samples, edges, dtype=np.int64), np.diff(np.append(edges, len(samples)))
    bright = sum(1 << k for k in range(8) if sums[k] * len(samples) > total * sizes[k])
    return f"mean={total / len(samples):.3f};distinct={len(share)};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};bright={bright:02x}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 as a WebP file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            raw = utf8(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(encode_payloads([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = bounded(docs).select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature from the stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media", 4 << 20):
            sizes, files, out = batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), []
            for n, file, pixels in zip(sizes, files, decode_payloads(files)):
                payload = payload_of(pixels, max(ROW, -(-n // ROW) * ROW))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(file), hashlib.sha256(file).hexdigest(), feature(pixels)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
