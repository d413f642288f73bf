"""Phrases that occur often, and how strongly their words belong together, by bitmaps of positions.

Texts are dealt out to shards of about ``SHARD`` bytes, cut at ends of pieces only.
Words of a shard get positions in a row, with one position left free between pieces,
so that nothing reaches over a piece's end.  A bitmap of a word or phrase has a bit
at each position where it ends; of its 64-bit blocks only those with a bit are kept.
A phrase goes on by a shift of its bitmap by one and an AND with the bitmap of what
may end there; the popcount is its number of occurrences.  Inside a shard phrases
are extended depth-first: a chunk of them is followed to the last word before the
next chunk begins, which bounds memory.

Popcounts are summed over shards in rounds.  ``DEPTHS`` says by how many words a
round extends; only phrases that are frequent over all shards are the base of the
next round, and a longer phrase is made of overlapping phrases of that base, so each
of its parts is frequent.  Which words can follow is read off the shard's list of
positions.  Between rounds a shard is one row, its list of base phrases by position.

Phrases are dealt to as many ranges as there are shuffle partitions, by a hash that
only deals.  A shard sends each range one block: keys in order, as differences whose
bytes are laid out by their place, and popcounts.  A task sums the blocks of a range,
gives frequent phrases global ids and sends each shard the places of its own.  Keys
are whole words, or the global ids of the base phrases, so counts are exact.  A phrase
has one key in a shard however often it occurs: no range is hotter than others.

Null text has no words; a null language is ``und``.  Rows that repeat count each.  A
very long text is spread over shards, one without any piece's end fills one.  Ties in
the ranking go by occurrences, then bytes of the phrase.  An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, cut, utf8, work_dir
from docloom.storage import remove

#: Bytes of text in a shard and in a slice of a long text, entries of bitmaps in a chunk, phrases that are sent on together.
SHARD, SLICE, CHUNK, ROWS = 8 << 20, 1 << 20, 1 << 18, 1 << 16
#: By how many words each round extends phrases.
DEPTHS = (1, 1, 2)
#: Bits of a shard's number within its task; the number of the task comes before them.
SHARD_BITS = 20
#: The ends of pieces.  In lower-cased bytes the letter A is free to stand for them.
ENDS, MARK = b".,;:!?\n\v\f\r", b"A"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + MARK * len(ENDS))


def slices(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text with marks between pieces, slice by slice, and whether the slice ends at a piece's end."""
    text = text.translate(_PLAIN)
    start, n = 0, len(text)
    while start < n:
        end, whole = min(start + SLICE, n), True
        if end < n:
            at = text.find(MARK, end)
            if at < 0:  # the rest is one piece
                at, whole = text.find(b" ", end), False
            end = at + 1 if at >= 0 else n
        yield text[start:end].replace(MARK, b" " + MARK + b" ").split(), whole or end == n
        start = end


class Shard:
    def __init__(self) -> None:
        numbers = count(1)
        self.words: defaultdict[str, defaultdict[bytes, int]] = defaultdict(lambda: defaultdict(numbers.__next__, {MARK: 0}))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes], end: bool) -> None:
        self.parts.append(np.fromiter(map(self.words[lang].__getitem__, words), np.int32, len(words)))
        if end:
            self.parts.append(np.zeros(1, np.int32))
        self.size += sum(map(len, words)) + len(words)

    def rows(self, shard: int, ranges: int) -> Iterator[dict]:
        """A block for each language and range, with words in order, then the shard itself, whose words are numbered in the order of the blocks."""
        at = np.concatenate(self.parts)
        counts, number, first = np.bincount(at), np.zeros(int(at.max()) + 1, np.int32), 1
        for lang, own in self.words.items():
            listed = sorted((zlib.crc32(w) % ranges, w, i) for w, i in own.items() if i)
            ids = np.array([i for _, _, i in listed], np.int32)
            number[ids] = np.arange(first, first + len(ids))
            for a, b in runs(np.array([r for r, _, _ in listed])):
                yield dict(range=listed[a][0], shard=shard, first=first + a, n=b - a, lang=lang, words=b" ".join(w for _, w, _ in listed[a:b]), counts=planes(counts[ids[a:b]]))
            first += len(ids)
        yield dict(shard=shard, at=planes(number[at]))


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes by their place, the lowest first, as many as the largest needs: what is alike comes together."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def numbers(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.empty(0, np.int64)
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : data[0]] = rows.T
    return out.reshape(-1).view("<i8")


_FIELDS = {"range": pa.int32(), "shard": pa.int64(), "at": pa.binary(), "first": pa.int32(), "n": pa.int32(), "lang": pa.string(), "words": pa.binary(), "depth": pa.int32(), "keys": pa.list_(pa.binary()), "counts": pa.binary()}
_DDL = "range int, shard bigint, at binary, first int, n int, lang string, words binary, depth int, keys array<binary>, counts binary"


def gathered(blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Blocks and shards as Arrow batches of some megabytes."""
    own, size = [], 0
    for x in blocks:
        own.append(x)
        size += 256 + sum(len(x.get(c) or b"") for c in ("at", "words", "counts")) + sum(map(len, x.get("keys") or ()))
        if size >= 4 << 20:
            yield pa.RecordBatch.from_pylist(own, pa.schema(_FIELDS))
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, pa.schema(_FIELDS))


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _sharded(limit: int, ranges: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task = TaskContext.get().partitionId() << SHARD_BITS
        shard, made = Shard(), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                for words, end in slices(text):
                    shard.add(lang, words, end)
                    if end and shard.size >= limit:
                        yield from shard.rows(task + made, ranges)
                        shard, made = Shard(), made + 1
                        if made >> SHARD_BITS:
                            raise ValueError("too many shards in one task")
        if shard.parts:
            yield from shard.rows(task + made, ranges)

    return lambda batches: gathered(blocks(batches))


class Bitmaps(NamedTuple):
    """Entries sorted by owner and block: the bit ``i`` of ``bits`` stands for the position ``64 * block + i``."""

    owner: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def shifted(self) -> Bitmaps:
        """Each bit one position on; what leaves a block goes to the next one."""
        low, over = self.bits << np.uint64(1), self.bits >> np.uint64(63)
        spill = np.flatnonzero(over)
        follows = np.zeros(len(spill), bool)
        inner = spill + 1 < len(self.owner)
        nxt = spill[inner] + 1
        follows[inner] = (self.owner[nxt] == self.owner[nxt - 1]) & (self.block[nxt] == self.block[nxt - 1] + 1)
        low[spill[follows] + 1] |= over[spill[follows]]
        new = spill[~follows]
        return Bitmaps(np.insert(self.owner, new + 1, self.owner[new]), np.insert(self.block, new + 1, self.block[new] + 1), np.insert(low, new + 1, over[new]))

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """The entry and the position of every bit."""
        entries, places, left, at = [], [], self.bits, np.arange(len(self.bits))
        while len(left):
            some = left != 0
            left, at = left[some], at[some]
            lowest = left & (~left + np.uint64(1))
            entries.append(at)
            places.append(self.block[at] * 64 + np.bitwise_count(lowest - np.uint64(1)))
            left = left ^ lowest
        return np.concatenate(entries or [np.empty(0, np.int64)]), np.concatenate(places or [np.empty(0, np.int64)])


class Base:
    """The bitmaps of a shard's frequent phrases, and the entry of each position."""

    def __init__(self, at: np.ndarray):
        pos = np.flatnonzero(at)
        pos = pos[np.argsort(at[pos], kind="stable")]
        owner, block = at[pos].astype(np.int64), pos >> 6
        first = np.ones(len(pos), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(first)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (pos & 63).astype(np.uint64), starts) if len(pos) else np.empty(0, np.uint64)
        self.maps = Bitmaps(owner[starts], block[starts], bits)
        self.entry = np.full(len(at) + 128, -1, np.int64)
        self.entry[pos] = np.cumsum(first) - 1

    def chunks(self) -> Iterator[Bitmaps]:
        """Runs of whole phrases with about CHUNK entries."""
        owner, n, start = self.maps.owner, len(self.maps.owner), 0
        while start < n:
            end = n if start + CHUNK >= n else int(np.searchsorted(owner, owner[start + CHUNK - 1], "right"))
            yield Bitmaps(*(x[start:end] for x in self.maps))
            start = end

    def extended(self, nodes: Bitmaps) -> tuple[Bitmaps, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of the phrases one word longer, and for each its owner before, its last base phrase and its popcount."""
        moved = nodes.shifted()
        at, pos = moved.positions()
        met = self.entry[pos]
        at, met = at[met >= 0], met[met >= 0]
        # one key for an owner and an entry: in their order, phrases and their blocks stand in order
        keys, one = np.unique(moved.owner[at] * len(self.entry) + met, return_index=True)
        at, met = at[one], met[one]
        bits = moved.bits[at] & self.maps.bits[met]
        parent, last = moved.owner[at], self.maps.owner[met]
        first = np.ones(len(keys), bool)
        first[1:] = (parent[1:] != parent[:-1]) | (last[1:] != last[:-1])
        starts = np.flatnonzero(first)
        counts = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts) if len(keys) else np.empty(0, np.int64)
        return Bitmaps(np.cumsum(first) - 1, self.maps.block[met], bits), parent[starts], last[starts], counts


def descend(at: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Phrases up to ``depth`` words longer than those of ``at``, depth-first: base ids (a column for each), popcounts; and the positions of the longest, as entry and position."""
    base = Base(at)
    for chunk in base.chunks():
        nodes, path = chunk, None
        for step in range(depth):
            nodes, parent, last, counts = base.extended(nodes)
            if not len(counts):
                break
            path = np.column_stack([parent, last]) if path is None else np.column_stack([path[parent], last])
            yield path, counts, nodes if step + 1 == depth else None


def grouped(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For keys of several columns: the place of one row of each key, and each row's key."""
    rank = columns[0]
    for c in columns[1:]:
        if (int(rank.max(initial=0)) + 1) * (int(c.max(initial=0)) + 1) >= 1 << 63:
            rank, c = np.unique(rank, return_inverse=True)[1], np.unique(c, return_inverse=True)[1]
        rank = rank * (int(c.max(initial=0)) + 1) + c
    return np.unique(rank, return_index=True, return_inverse=True)[1:]


def _dealt(keys: np.ndarray, ranges: int) -> np.ndarray:
    mixed = np.zeros(len(keys), np.uint64)
    for c in keys.T:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(ranges)).astype(np.int64)


def _summed(min_count: int, ranges: int):
    """Sums of the blocks of each range: rows of frequent phrases, and for each shard rows with its places of them."""
    names = ["shard", "at", "first", "places", "gids", "gid", "depth", "lang", "word", "keys", "n"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]

    def filled(size: int, /, **own: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(size, t) for c, t in zip(names, types)], names=names)

    def one(own: list[dict], taken: int) -> Iterator[pa.RecordBatch | int]:
        counts = np.concatenate([numbers(r["counts"]) for r in own])
        words = columns = None
        if own[0]["keys"] is None:
            words = [w for r in own for w in r["words"].split(b" ")]
            which = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
            at = np.unique(which, return_index=True)[1]
        else:
            columns = [np.concatenate([np.cumsum(numbers(r["keys"][0])) if i == 0 else numbers(r["keys"][i]) for r in own]) for i in range(len(own[0]["keys"]))]
            at, which = grouped(columns)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, which, counts)
        often = np.flatnonzero(total >= min_count)
        gid = np.full(len(at), -1, np.int64)
        gid[often] = (taken + np.arange(len(often))) * ranges + own[0]["range"]  # no other range has these
        for k in range(0, len(often), ROWS):
            some = often[k : k + ROWS]
            n, more = len(some), {}
            if words is not None:
                more = {"lang": pa.array([own[0]["lang"]] * n, pa.string()), "word": pa.array([_text(words[i]) for i in at[some]], pa.string())}
            else:
                more = {"keys": pa.array(np.stack([c[at[some]] for c in columns], axis=1).tolist(), pa.list_(pa.int64())), "depth": pa.array([own[0]["depth"]] * n, pa.int32())}
            yield filled(n, gid=pa.array(gid[some]), n=pa.array(total[some]), **more)
        start = 0
        for r in own:
            mine = gid[which[start : start + r["n"]]]
            start += r["n"]
            if len(places := np.flatnonzero(mine >= 0)):
                yield filled(1, shard=pa.array([r["shard"]], pa.int64()), first=pa.array([r["first"]], pa.int32()), depth=pa.array([r["depth"]], pa.int32()), places=pa.array([planes(np.diff(places, prepend=0))], pa.binary()), gids=pa.array([planes(mine[places])], pa.binary()))
        yield len(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        taken, last = 0, None
        same = lambda r: (r["range"], r["depth"], r["lang"])

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal taken, last
            if group:
                taken, last = (taken if group[0]["range"] == last else 0), group[0]["range"]
                for made in one(group, taken):
                    if isinstance(made, int):
                        taken += made
                    else:
                        yield made

        for batch in batches:
            for row in batch.to_pylist():
                if group and same(group[0]) != same(row):
                    yield from done()
                    group = []
                group.append(row)
        yield from done()

    return run, "shard bigint, at binary, first int, places binary, gids binary, gid bigint, depth int, lang string, word string, keys array<bigint>, n bigint"


def _extended(depth: int, last: bool, ranges: int):
    def extend(shard: int, before: np.ndarray, ids: np.ndarray, gids: np.ndarray) -> Iterator[dict]:
        remap = np.zeros(max(int(before.max(initial=0)), int(ids.max(initial=0))) + 1, np.int32)
        remap[ids] = np.arange(1, len(ids) + 1)
        at, names = remap[before], np.concatenate([np.zeros(1, np.int64), gids])
        paths: dict[int, list[np.ndarray]] = defaultdict(list)
        counts: dict[int, list[np.ndarray]] = defaultdict(list)
        after, made = np.zeros(len(at), np.int32), 0
        for path, n, nodes in descend(at, depth):
            step = path.shape[1] - 1
            paths[step].append(names[path])
            counts[step].append(n)
            if nodes is not None and not last:
                entry, pos = nodes.positions()
                after[pos] = made + 1 + nodes.owner[entry]
                made += len(n)
        for step in sorted(paths):
            keys, n = np.concatenate(paths.pop(step)), np.concatenate(counts.pop(step))
            to = _dealt(keys, ranges)
            order = np.lexsort([*keys.T[::-1], to])
            keys, n, to = keys[order], n[order], to[order]
            if step == depth and not last:  # the base of the next round is numbered in the order of the blocks
                number = np.zeros(len(order) + 1, np.int32)
                number[order + 1] = np.arange(1, len(order) + 1)
                after = number[after]
            for a, b in runs(to):
                own = [planes(np.diff(keys[a:b, 0], prepend=0)), *(planes(keys[a:b, i]) for i in range(1, keys.shape[1]))]
                yield dict(range=int(to[a]), shard=shard, first=a + 1, n=b - a, depth=step, keys=own, counts=planes(n[a:b]))
        if not last:
            yield dict(shard=shard, at=planes(after))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, at, ids, gids = None, None, [], []

        def done() -> Iterator[dict]:
            if at is not None and ids:
                yield from extend(shard, at, np.concatenate(ids), np.concatenate(gids))

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    yield from done()
                    shard, at, ids, gids = row["shard"], None, [], []
                if row["at"] is not None:  # the shard's own row comes first
                    at = numbers(row["at"])
                else:
                    ids.append(row["first"] + np.cumsum(numbers(row["places"])))
                    gids.append(numbers(row["gids"]))
        yield from done()

    return lambda batches: gathered(blocks(batches))


def frequent_phrases(docs: DataFrame, folder: str, min_count: int, depths: Sequence[int] = DEPTHS, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n) of all phrases with ``min_count`` occurrences or more; (lang, total): occurrences of all words.  Both read tables in ``folder``."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(docs).select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    rows.mapInArrow(_sharded(shard_bytes, ranges), _DDL).write.parquet(path := f"{folder}/round-0")
    table = spark.read.schema(_DDL).parquet(path)
    found: list[DataFrame] = []
    base = None
    for i in range(len(depths) + 1):
        blocks = table.filter("at is null").repartition("range").sortWithinPartitions("range", "depth", "lang", "shard")
        run, ddl = _summed(min_count, ranges)
        blocks.mapInArrow(run, ddl).write.parquet(kept_path := f"{folder}/kept-{i}")
        kept = spark.read.schema(ddl).parquet(kept_path)
        phrases = kept.filter("gid is not null")
        if base is None:
            named = phrases.select("gid", "lang", F.array("word").alias("words"), "n", F.lit(0).alias("depth"))
        else:
            named = phrases.join(base.select(F.col("gid").alias("_g"), F.col("lang").alias("_lang"), "words"), F.get("keys", F.lit(0)) == F.col("_g"))
            for k in range(1, depths[i - 1] + 1):  # each further base phrase adds its last word
                tail = base.select(F.col("gid").alias("_t"), F.element_at("words", -1).alias("_last"))
                named = named.join(tail, F.get("keys", F.lit(k)) == F.col("_t"), "left").withColumn("words", F.when(F.col("_last").isNotNull(), F.concat("words", F.array("_last"))).otherwise(F.col("words"))).drop("_t", "_last")
            named = named.select("gid", F.col("_lang").alias("lang"), "words", "n", "depth")
        named.write.parquet(f"{folder}/phrases-{i}")
        named = spark.read.parquet(f"{folder}/phrases-{i}")
        found.append(named.select("lang", "words", "n"))
        if i == len(depths):
            break
        mine = kept.filter("shard is not null")
        if base is not None:  # the longest phrases of the round are the base of the next one
            mine, named = mine.filter(F.col("depth") == depths[i - 1]), named.filter(F.col("depth") == depths[i - 1])
        else:
            totals = table.filter("at is null").select("lang", "n", "counts").mapInArrow(_totals, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("total"))
            totals.write.parquet(f"{folder}/totals")
        base = named.select("gid", "lang", "words")
        shards = table.filter("at is not null").select("shard", "at", F.lit(None).cast("int").alias("first"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("gids"))
        dealt = shards.unionByName(mine.select("shard", "at", "first", "places", "gids")).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("first"))
        dealt.mapInArrow(_extended(depths[i], i + 1 == len(depths), ranges), _DDL).write.parquet(path := f"{folder}/round-{i + 1}")
        remove(spark, f"{folder}/round-{i}")
        table = spark.read.schema(_DDL).parquet(path)
    remove(spark, f"{folder}/round-{len(depths)}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, spark.read.parquet(f"{folder}/totals")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(numbers(x).sum()) for x in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(sums, pa.int64())], names=["lang", "n"])


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one of as many occurrences holds."""
    named = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("n").alias("a"))
    several = named.filter(F.size("words") > 1)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = several.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words")).alias("rest"))
    count_as = lambda name, n: named.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    both = cuts.join(count_as("first", "l"), ["lang", "first"]).join(count_as("rest", "r"), ["lang", "rest"]).join(totals.select("lang", F.col("total").alias("n")), "lang")
    wide = lambda c: f"cast({c} as decimal(18,0))"  # noqa: E731  whole decimals of 38 digits hold the products
    score = F.expr(f"cast({wide('a')} * {wide('n')} * 1000 as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    inner = several.filter(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    held = inner.select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return left.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, depths: Sequence[int] = DEPTHS, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    spark = docs.sparkSession
    folder = work_dir(spark, "phrases")
    try:
        rows = scored(*frequent_phrases(docs, folder, min_count, depths, text, lang, shard_bytes))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # a large language is ranked in parts first
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
        rows = rows.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        return cut(rows.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        remove(spark, folder)
