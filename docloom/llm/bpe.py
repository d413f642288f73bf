"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged
over, so the place between them is a certain cut.  Together with the cuts of
the vocabulary's split pattern this leaves short fragments, which are encoded
independently and concatenated.  A batch of documents is handled at once in
numpy: character classes give the pieces, a hash finds pieces that may be known
and their characters are compared, and the fragments of all new pieces are
merged side by side.

Null texts are empty: no ids.  Repeated rows give repeated rows; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.common import bounded, small_batches, texts

#: Endings that the split pattern of byte-level vocabularies takes together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Known pieces of one worker, and their characters; beyond that it starts afresh.
MEMORY, CHARACTERS = 300_000, 1 << 24
#: Slots of the table that finds known pieces.
SLOTS = 1 << 20
#: Longer fragments are merged with a heap, one at a time.
LONG = 200
LETTER, NUMBER, SPACE, EDGE, NEVER = 1, 2, 3, 4, np.int32(2**31 - 1)
#: Codes past Unicode: the end of a document, and special token k at END + 1 + k.
END = 0x110000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def byte_letters() -> list[str]:
    """The printable letter by which vocabulary files write each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each character: letter, number, white space, edge of a text, or 0."""
    out = np.zeros(END + 256, np.uint8)
    out[END:] = EDGE
    for low in range(0, END, 0x1000):
        if not 0xD800 <= low < 0xE000:
            block = "".join(map(chr, range(low, low + 0x1000)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, block):
                    out[low + m.start() : low + m.end()] = kind
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return step(_BASE), step(pow(_BASE, -1, 2**64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def piece_starts(cp: np.ndarray) -> np.ndarray:
    """Where the split pattern begins a piece: runs of letters, of numbers or of other signs, each with one space before it; apostrophe endings; rest of white space."""
    kind = classes()[cp]
    start = np.empty(len(cp), bool)
    start[:1] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    at = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != EDGE)) + 1
    start[at - 1] = True
    start[at[cp[at - 1] == 32]] = False
    at = np.flatnonzero(start & (cp == 39))
    padded = np.concatenate([cp, np.full(3, END, cp.dtype)])
    for ending in ENDINGS:
        hit = at[np.logical_and.reduce([padded[at + 1 + j] == ord(c) for j, c in enumerate(ending)])]
        start[hit + 1] = False
        after = hit + 1 + len(ending)
        start[after[after < len(cp)]] = True
    return start


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` values or more."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        raw = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*raw.values(), *self.special.values()]) + 1)
        for token, i in [*raw.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.tokens[i] = token
        self.single = np.array([raw[bytes([b])] for b in range(256)], np.int32)
        pairs = [tuple(bytes(back[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        keys = np.array([raw[a] << 20 | raw[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks, self._made = keys[order], order.astype(np.int32), np.array([raw[a + b] for a, b in pairs], np.int32)
        self.joined = np.zeros((256, 256), bool)
        for token in raw:
            for pair in zip(token, token[1:]):
                self.joined[pair] = True
        self._special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._codes = {t: (END + 1 + k).to_bytes(4, "little") for k, t in enumerate(self.special)}
        self._forget()

    def _forget(self) -> None:
        self._slot_hash, self._slot_piece = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self._known: dict[int, int] = {}  # by hash
        self._other: dict[bytes, int] = {}  # pieces whose hash is that of another known piece, by their characters
        # ids and characters of known pieces, one after the other, and where each piece's begin
        self._pool, self._offset, self._length = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._chars, self._char_at, self._char_count = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._pieces = self._used = self._used_chars = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b, NEVER where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def _merge_long(self, symbols: np.ndarray) -> list[int]:
        ids, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in found:
                found[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return found[a, b]

        queue = [(r, i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(*pair)) != NEVER]
        heapq.heapify(queue)
        while queue:
            r, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = int(self._made[r]), -1, after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    before[y] = x
                    if (r := rank(ids[x], ids[y])) != NEVER:
                        heapq.heappush(queue, (r, x, (ids[x], ids[y])))
        return [x for x in ids if x >= 0]

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, given as bytes one after the other, and the count for each piece."""
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.ones(len(raw), bool)
        begins[1:] = (piece[1:] != piece[:-1]) | ~self.joined[raw[:-1], raw[1:]]  # the forced boundaries
        fragment, symbol = np.cumsum(begins) - 1, self.single[raw]
        first = np.flatnonzero(begins)
        owner, length = piece[first], np.diff(np.append(first, len(raw)))
        done = []
        for f in np.flatnonzero(length > LONG):
            ids = self._merge_long(symbol[first[f] : first[f] + length[f]])
            done.append((np.full(len(ids), f), np.array(ids, np.int32)))
        stay = np.repeat(length <= LONG, length)
        fragment, symbol = fragment[stay], symbol[stay]
        rank = np.full(len(symbol), NEVER)
        inner = np.flatnonzero(fragment[1:] == fragment[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbol)))
            if (over := least == NEVER).any():
                ready = np.repeat(over, length)
                done.append((fragment[ready], symbol[ready]))
                stay = ~ready
                fragment, symbol, rank, least, length = fragment[stay], symbol[stay], rank[stay], least[~over], length[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            at = at[np.concatenate([[True], fragment[at[1:]] != fragment[at[:-1]]])]  # the leftmost of each fragment
            symbol[at] = self._made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            rank[at] = NEVER
            fragment, symbol, rank = fragment[stay], symbol[stay], rank[stay]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(symbol)]
                i = i[fragment[i] == fragment[i + 1]]
                rank[i] = self.rank(symbol[i], symbol[i + 1])
        fragment, symbol = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int32) for k in (0, 1))
        order = np.argsort(fragment, kind="stable")
        return symbol[order].astype("<u4"), np.bincount(owner[fragment], minlength=len(sizes))

    def _learn(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Encodes new pieces and keeps them with their characters; returns their numbers."""
        flat = cp[ragged(start, length)]
        width = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000).astype(np.int64)
        sizes = np.add.reduceat(width, np.cumsum(length) - length)
        ids, counts = self.merge(np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8), sizes)
        new = np.arange(self._pieces, self._pieces + len(counts))
        self._pool, self._chars = _roomy(self._pool, self._used + len(ids)), _roomy(self._chars, self._used_chars + len(flat))
        self._offset, self._length, self._char_at, self._char_count = (_roomy(x, self._pieces + len(new)) for x in (self._offset, self._length, self._char_at, self._char_count))
        self._pool[self._used : self._used + len(ids)] = ids
        self._chars[self._used_chars : self._used_chars + len(flat)] = flat
        self._offset[new], self._length[new] = self._used + np.cumsum(counts) - counts, counts
        self._char_at[new], self._char_count[new] = self._used_chars + np.cumsum(length) - length, length
        self._pieces, self._used, self._used_chars = self._pieces + len(new), self._used + len(ids), self._used_chars + len(flat)
        return new

    def _others(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which of the pieces, that lie side by side in ``cp``, are other characters than the known ``piece``."""
        other = self._char_count[piece] != length
        at = np.repeat((self._char_at[piece] - start).astype(np.int32), length)
        at += np.arange(len(cp), dtype=np.int32)
        unequal = self._chars.take(at, mode="clip") != cp
        if unequal.any():
            other |= np.add.reduceat(unequal, start, dtype=np.int64) > 0
        return np.flatnonzero(other)

    def encode_many(self, batch: list[str], specials: bool = True) -> list[np.ndarray]:
        """Ids (uint32) of each text; a special token's text is that token, or ordinary text without ``specials``."""
        if not batch:
            return []
        parts = []
        for text in batch:
            if specials and self._special_at and any(s in text for s in self.special):
                parts.append(b"".join(self._codes.get(x) or x.encode("utf-32-le", "replace") for x in self._special_at.split(text)))
            else:
                parts.append(text.encode("utf-32-le", "replace"))
        cp = np.frombuffer(END.to_bytes(4, "little").join([*parts, b""]), "<u4")
        start = np.flatnonzero(piece_starts(cp))
        length = np.diff(np.append(start, len(cp)))
        edge = cp[start] >= END
        power, inverse = _powers(1 << max(20, int(len(cp)).bit_length()))
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(31)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mixed * power[: len(cp)], out=total[1:])
        hashes = (total[start + length] - total[start]) * inverse[start] + length.astype(np.uint64) * np.uint64(_MIX)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX)
        hashes ^= hashes >> np.uint64(32)
        if self._pieces > MEMORY or self._used_chars > CHARACTERS:
            self._forget()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        piece = self._slot_piece[slot].astype(np.int64)
        miss = np.flatnonzero((self._slot_hash[slot] != hashes) & ~edge)
        if len(miss):
            fresh, at, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            unknown = np.array([h not in self._known for h in fresh.tolist()])
            new = miss[at[unknown]]
            if len(new):
                self._known.update(zip(fresh[unknown].tolist(), self._learn(cp, start[new], length[new]).tolist()))
            index = np.array([self._known[h] for h in fresh.tolist()])
            where = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
            self._slot_hash[where], self._slot_piece[where] = fresh, index
            piece[miss] = index[which]
        # an edge is no known piece
        others = self._others(cp, start, length, piece)
        for i in others[~edge[others]].tolist():
            key = cp[start[i] : start[i] + length[i]].tobytes()
            if key not in self._other:
                self._other[key] = int(self._learn(cp, start[i : i + 1], length[i : i + 1])[0])
            piece[i] = self._other[key]
        counts = np.where(edge, (cp[start] > END).astype(np.int64), self._length[piece])
        source = np.where(edge, 0, self._offset[piece])
        flat = self._pool[ragged(source, counts)]
        special = np.flatnonzero(edge & (cp[start] > END))
        if len(special):
            ends = np.cumsum(counts)
            flat[ends[special] - 1] = np.array(list(self.special.values()))[cp[start[special]] - END - 1]
        ends = np.cumsum(counts)[cp[start] == END]
        return np.split(flat, ends[:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; special tokens are kept, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text", specials: bool = True) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small batches with the ids of their rows; for use inside mapInArrow."""
    c = codec(path)
    for batch in small_batches(batches, column, 1 << 20):
        yield batch, c.encode_many(texts(batch.column(column)), specials)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (little-endian uint32), one row for each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, path):
            yield pa.record_batch([batch.column("key"), pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs).select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key``, ``text`` of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[key].alias("key"), rows[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids stay in the worker; only the digests return to Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, ids in encoded(batches, path):
            of_ids = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            of_text = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
