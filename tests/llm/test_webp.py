import base64
import hashlib
import zlib

import numpy as np
import pytest

from docloom.llm import media, webp

RNG = np.random.default_rng(0)


def images():
    for h, w, k in [(1, 1, 1), (5, 7, 3), (16, 9, 16), (20, 33, 200), (13, 64, 2)]:
        colours = RNG.integers(0, 2**32, k, dtype=np.uint32)
        pixels = colours[RNG.integers(0, k, (h, w))]
        pixels[h // 2 :] = pixels[: h - h // 2]
        yield pixels
        yield (((np.arange(h)[:, None] * 3 + np.arange(w)[None, :] * 5) % 256) * 0x01010101).astype(np.uint32)


def block(pixels, bits, high):
    h, w = (-(-n >> bits) for n in pixels.shape)
    return RNG.integers(0, high, (h, w), dtype=np.uint32)


@pytest.mark.parametrize("cache", [0, 1, 10])
def test_round_trips(cache):
    for pixels in images():
        factors, modes = block(pixels, 2, 2**32 - 1), block(pixels, 3, 14)
        options = [(), ((webp.SUBTRACT_GREEN,),), ((webp.CROSS_COLOUR, 2, factors),), ((webp.PREDICTOR, 3, modes),), ((webp.PREDICTOR, 3, modes), (webp.CROSS_COLOUR, 2, factors), (webp.SUBTRACT_GREEN,)), ((webp.PALETTE,),)]
        for transforms in options:
            file = webp.encode(pixels, transforms, cache)
            assert (webp.decode(file) == pixels).all(), transforms
            assert (webp.decode_many([file, file])[1] == pixels).all()


def test_groups_of_codes():
    """Two groups of codes, chosen by an entropy image: the left four columns all 1, the right four all 2."""
    w = webp.Writer()
    webp.head(w, 8, 4)
    w.bits(0, 2)  # no transform, no colour cache
    w.bits(1, 1)
    w.bits(0, 3)  # blocks of 4 pixels
    webp.write_image(w, np.array([[0, 1 << 8]], np.uint32), False)
    for green in (1, 2):
        for lengths in ([0] * green + [1] + [0] * (279 - green), [1], [1], [0] * 255 + [1], [0] * 40):
            webp.write_lengths(w, lengths)
    pixels = webp.decode(webp.container(w.value.to_bytes(-(-w.size // 8) + 1, "little")))
    assert (pixels[:, :4] == 0xFF000100).all() and (pixels[:, 4:] == 0xFF000200).all()


def test_damaged_files():
    file = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for broken in (b"", file[:12], b"RIFX" + file[4:], file[:16] + (5).to_bytes(4, "little") + file[20:25]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(broken)


def test_a_file_of_another_writer():
    """A widely used test image for lossless WebP, one transparent pixel."""
    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(file).tolist() == [[0]] and webp.decode_many([file])[0].tolist() == [[0]]


def parts_of(file):
    """Names of what the images of a file use."""
    out = set()
    for tile in media.tiles_of(file):
        image = webp.Image(tile)
        r = webp.Reader(tile[20:])
        r.bits(40)
        if r.bits(1):
            out.add(("predictor", "cross", "subtract", "palette")[r.bits(2)])
        out |= {"cache"} if image.coded.cache_bits else set()
        out |= {"copies"} if any(np.any(image.coded.codes[0][0][0] >> 4 == s) for s in range(256, 280)) else set()
    return out


def test_what_pays_is_used():
    """The stored files use every part of the format that their content suggests, and are read back."""
    n = np.arange(64 * 256)
    prose = " ".join(RNG.choice(["river", "stone", "cloud", "maple", "orbit", "of", "the"], 1200)).encode()
    contents = {
        "cache": media.padded(prose),
        "copies": RNG.integers(0, 256, 64 * 20, dtype=np.uint8).tobytes() * 9,
        "palette": RNG.choice(np.frombuffer(b"abcdefgh" * 4, "<u4") + np.arange(8, dtype="<u4") * 7919, 64 * 64).astype("<u4").tobytes(),
        "predictor": ((n // 4 * 3 + n % 4 * 50 + RNG.integers(0, 2, len(n))) % 256).astype(np.uint8).tobytes(),
        "cross": np.stack([RNG.integers(0, 256, 4096), (green := RNG.integers(0, 128, 4096)), green + RNG.integers(0, 3, 4096), np.full(4096, 255)], 1).astype(np.uint8).tobytes(),
    }
    for name, content in contents.items():
        (file,) = media.encode_payloads([content])
        assert name in parts_of(file), (name, parts_of(file))
        assert media.payload_of(media.decode_payloads([file])[0], len(content)) == content
        assert media.payload_of(np.concatenate([webp.decode(t) for t in media.tiles_of(file)]), len(content)) == content


def test_code_lengths():
    for counts in ([1] * 256, [2**i for i in range(40)], [5], [0, 3, 4], [0] * 9):
        lengths = webp.code_lengths(counts)
        used = [n for n in lengths if n]
        assert len(used) == sum(map(bool, counts)) and max(lengths) <= webp.MOST
        assert len(used) < 2 or sum(2.0**-n for n in used) == 1
    assert len(set(webp.NEAR_XY)) == 120


def payloads():
    texts = ["", "a", "a" * 70000, "ab" * 5000, "0123456789abcdef" * 99, "".join(map(chr, range(1, 500))) * 3, "row of sixty-four bytes, which comes again and again and again.. " * 40]
    return [media.padded(t.encode()) for t in texts] + [bytes(RNG.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 3, 300)]


def test_payloads():
    data = payloads()
    files = media.encode_payloads(data)
    for want, file, pixels in zip(data, files, media.decode_payloads(files), strict=True):
        assert media.payload_of(pixels, len(want)) == want
        one_by_one = np.concatenate([webp.decode(t) for t in media.tiles_of(file)])
        assert (one_by_one == pixels).all()
        assert media.encode_payloads([want]) == [file]  # whatever is encoded beside it
    assert len(files[2]) < 300


def test_columns(odd_docs, no_docs):
    rows = media.read_back(media.store(odd_docs)).collect()
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        p = media.padded(raw)
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert len({r.media_sha256 for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.read_back(media.store(no_docs)).count() == 0
