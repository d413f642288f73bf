"""Near copies by Jaccard similarity of word shingles, found by SimHash fingerprints in shards of rare shingles.

Two texts link where their sets of shingles have a Jaccard similarity of 0.8 or
more (``SHARE``).  At that similarity fingerprints of 64 bits differ in about ten
bits, too many for shards by blocks of bits, so shards are made of shingles: of n
shingles in any fixed order, two linked texts share one among the first
n - ceil(0.8 n) + 1.

1. Shingles are dealt out by their hash and counted.  Those of one text only link
   nothing; the others go back to their text.
2. Of each text the rarest shingles, as many as above, name its shards.  So common
   passages count only in texts that hold little else.
3. In each shard all texts meet the one with the fewest rare shingles, so a group
   of edited copies is linked by its original.  Then vantage-point trees over the
   fingerprints find pairs within ``RADIUS`` bits, from points of different
   components only.  A pair counts in a shard only if what both texts hold from
   the shard's shingle on suffices for a link.
4. Every link is checked by the whole sets of both texts.

Fingerprints are those of the sets.  At a similarity of 0.8 a bit differs with
probability 0.15, so one of about 10^6 links at just that similarity would differ
in more than ``RADIUS`` bits; sets under ``SMALL`` shingles aren't held to it.

Texts of equal sets are one point.  Null text is empty; texts without words are
copies of each other, texts under ``words`` words are one shingle.  Shingles, and
sets, of equal 64-bit hash count as equal.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, cut, small_batches, utf8
from docloom.llm.simhash import Forest, component_ids, connected, majority, shingle_hashes

#: The least similarity of a link, as a fraction.
SHARE = (4, 5)
#: Differing bits of fingerprints that are looked for, and sets too small to be told by them.
RADIUS, SMALL = 24, 32
#: Ranges of hashes by which shingles are dealt out, as bits.
DEAL_BITS = 12
PAIRS = 1 << 16


def _sets(batch: pa.RecordBatch, words: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted shingles of each text, and the hash of each such set."""
    sets = [np.unique(np.array(shingle_hashes(t, words, seed), np.uint64)) for t in utf8(batch.column("text"))]
    return sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> np.ndarray | None:
    parts = [np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(columns)]) for b in batches if b.num_rows]
    return np.concatenate(parts, axis=1) if parts else None


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), PAIRS):
        yield pa.record_batch([pa.array(c[at : at + PAIRS]) for c in columns], names)


def set_ids(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, sid (hash of the text's set), n (its size), fp (its fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            sets, sid = _sets(batch, words, seed)
            fp = majority(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array(list(map(len, sets)), np.int64))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sid), pa.array(list(map(len, sets)), pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "sid", "n", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sid long, n long, fp long")


def whole_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """sid, n, h (the shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets, sid = _sets(batch, words, seed)
            yield pa.record_batch([pa.array(sid), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "n", "h"])

    return docs.mapInArrow(run, "sid long, n long, h array<long>")


def shared_shingles(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """sid, h, m: the shingles that m different sets hold, m > 1."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets, sid = _sets(batch, words, seed)
            sid, at = np.unique(sid, return_index=True)
            h = np.concatenate([sets[i] for i in at])
            if not len(h):
                continue
            own = np.repeat(sid, [len(sets[i]) for i in at])
            by = np.argsort(h)
            h, own = h[by], own[by]
            deal = (h >> np.uint64(64 - DEAL_BITS)).astype(np.int32)
            edge = np.flatnonzero(np.diff(deal, prepend=-1))
            offsets = pa.py_buffer((np.append(edge, len(h)) * 8).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(edge), [None, offsets, pa.py_buffer(np.ascontiguousarray(c))]) for c in (h, own)]
            yield pa.record_batch([pa.array(deal[edge]), *packed], ["deal", "h", "sid"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[bytes]] = [[], []]
        for batch in batches:
            for k in (0, 1):
                parts[k] += batch.column(k + 1).to_pylist()
        h, sid = (np.frombuffer(b"".join(p), np.int64) for p in parts)
        if not len(h):
            return
        by = np.lexsort((sid, h))
        h, sid = h[by], sid[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        h, sid = h[new], sid[new]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        m = np.diff(np.append(head, len(h)))
        m = np.repeat(m, m)
        yield from _sliced([sid[m > 1], h[m > 1], m[m > 1]], ["sid", "h", "m"])

    return docs.mapInArrow(deal, "deal int, h binary, sid binary").repartition("deal").mapInArrow(count, "sid long, h long, m long")


def rare_index(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """h, sid, n, rest, fp: of each set the shared ones among its first n - ceil(0.8 n) + 1 shingles, rarest first.

    ``rest`` is how many shingles the set has from h on.
    """
    part, of = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _whole(batches, 4)
        if x is None:
            return
        sid, h, m, fp = x[:, np.lexsort((x[1], x[2], x[0]))]
        head = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))  # the size comes first, as less than zero
        count = np.diff(np.append(head, len(sid)))
        n = -m[head]
        alone = n - (count - 1)  # shingles of no other set come before all others
        take = n + (-part * n // of) + 1 - alone
        place = np.arange(len(sid)) - np.repeat(head, count)
        stay = (place > 0) & (place <= np.repeat(take, count))
        rest = np.repeat(n - alone, count) - place + 1
        yield from _sliced([h[stay], sid[stay], np.repeat(n, count)[stay], rest[stay], np.repeat(fp[head], count)[stay]], ["h", "sid", "n", "rest", "fp"])

    none = F.lit(0).cast("long")
    rows = shared.select("sid", "h", "m", none.alias("fp")).unionByName(sizes.select("sid", none.alias("h"), (-F.col("n")).alias("m"), "fp"))
    return rows.repartition("sid").mapInArrow(run, "h long, sid long, n long, rest long, fp long")


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of ``SHARE``, if nothing is shared before the shard's shingle."""
    part, of = SHARE
    return np.minimum(rest[i], rest[j]) * (part + of) >= (n[i] + n[j]) * part


def _pairs(index: DataFrame, every: bool, radius: int) -> DataFrame:
    """a, b: sets of one shard that may link; with the shard's least rare one only, or ``every`` pair of different ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _whole(batches, 6)
        if x is None:
            return
        h, sid, n, rest, fp, label = x[:, np.lexsort((x[1], x[3], x[0]))]
        points, new = fp.view(np.uint64), np.concatenate([[True], h[1:] != h[:-1]])
        shard = np.cumsum(new) - 1

        def out(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            near = (np.bitwise_count(points[i] ^ points[j]) <= radius) | (np.minimum(n[i], n[j]) < SMALL)
            fits = near & (sid[i] != sid[j]) & _possible(i, j, n, rest)
            both = np.unique(np.sort(np.stack([sid[i[fits]], sid[j[fits]]]), axis=0), axis=1)
            yield from _sliced([both[0], both[1]], ["a", "b"])

        if not every:
            stop = np.append(np.flatnonzero(new)[1:], len(h))
            yield from out(np.arange(len(h)), stop[shard] - 1)
            return
        # of shards of one component nothing is looked for
        head = np.flatnonzero(new)
        mixed = (np.maximum.reduceat(label, head) != np.minimum.reduceat(label, head))[shard]
        # small sets are compared by size, in the order of their sizes, all others by the trees
        at = np.flatnonzero(mixed & (n >= SMALL))
        for i, j in Forest(points[at], shard[at], radius, label[at]).pairs():
            yield from out(at[i[i < j]], at[j[i < j]])
        part, of = SHARE
        at = np.flatnonzero(mixed & (n * part <= SMALL * of))
        at = at[np.lexsort((n[at], shard[at]))]
        key = shard[at] * (2 * SMALL) + n[at]
        high = np.searchsorted(key, shard[at] * (2 * SMALL) + np.minimum(n[at] * of // part, 2 * SMALL - 1), "right")
        held, size = [], 0
        for k in range(len(at)):
            j = np.arange(k + 1, high[k]) if n[at[k]] < SMALL else np.zeros(0, np.int64)
            j = at[j][label[at[j]] != label[at[k]]]
            held.append(np.stack([np.full(len(j), at[k]), j]))
            size += len(j)
            if size > PAIRS or k + 1 == len(at):
                yield from out(*np.concatenate(held, axis=1))
                held, size = [], 0

    return index.select("h", "sid", "n", "rest", "fp", "label").repartition("h").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets have a Jaccard similarity of ``SHARE`` or more."""
    part, of = SHARE
    one, other = (sets.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("h").alias(f"h_{k}")) for k in ("a", "b"))
    both = pairs.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("h_a", "h_b")))
    return both.filter(F.col("common") * (part + of) >= (F.col("n_a") + F.col("n_b")) * part).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    docs = bounded(docs).select("doc_id", "text")
    ids = cut(set_ids(docs, words, seed))
    groups = cut(ids.groupBy("sid").agg(F.first("n").alias("size"), F.first("fp").alias("fp"), F.min("doc_id").alias("first"), F.count("*").alias("n")))
    sizes = groups.select("sid", F.col("size").alias("n"), "fp", "first")
    index = cut(rare_index(shared_shingles(docs, words, seed), sizes), free=True)
    # the whole sets of the texts that are compared, each from one of its rows
    index = cut(index.join(index.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "h", "left_semi"), free=True)
    pairs = cut(_pairs(index.withColumn("label", F.lit(0).cast("long")), False, radius))
    links = cut(_verified(pairs, _sets_of(pairs, docs, sizes, words, seed)), free=True)
    roots = connected(links)
    labelled = index.join(roots, index["sid"] == roots["node"], "left").select("h", "sid", "n", "rest", "fp", F.coalesce("root", "sid").alias("label"))
    pairs = cut(_pairs(labelled, True, radius), free=True)
    more = cut(_verified(pairs, _sets_of(pairs, docs, sizes, words, seed)), free=True)
    return component_ids(ids, groups, links.unionByName(more), "sid").select("doc_id", "fp", "component_id")


def _sets_of(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, words: int, seed: int) -> DataFrame:
    """sid, n, h of the sets that the pairs name."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = sizes.join(named, "sid", "left_semi").select(F.col("first").alias("doc_id"))
    found = docs.join(wanted, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    return whole_sets(found, words, seed).dropDuplicates(["sid"])
