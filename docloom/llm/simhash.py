"""SimHash fingerprints and near-duplicate components by vantage-point trees.

A fingerprint has 64 bits; documents link at ``radius`` or fewer differing bits.
Equal fingerprints are merged first, so a group of copies is one point.

Shards: the 64 bits are cut into radius + m blocks.  Of two linked fingerprints
at least m blocks are at Hamming distance zero, so a point belongs to the shard
of each choice of m of its blocks, and shards overlap at just those points that
may have a link across.  m is 1, or more where that would leave over
``SHARD_POINTS`` points in an even shard; every m finds the same links.  Every shard holds a vantage-point tree: points are split by
Hamming distance from a vantage, a branch is skipped when the triangle bound
puts all of it out of reach, and also when it is known to be in the query's own
component already, so a dense group costs no pairs.  A shard returns a spanning
forest of its links; the forests' components are found by alternating large and
small stars in Spark.

Null text is empty: no words, fingerprint zero, linked like any other.  A null
doc_id never is a component's id unless the component has no other.  Repeated
rows are points of equal fingerprint.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, cut, hot_keys, salted_join, small_batches, utf8

LEAF = 8
QUERIES = 8192
#: Points of an even shard beyond which its key takes one more block.
SHARD_POINTS = 4096


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of all words where there are fewer; none without words."""
    parts = text.lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not parts:
        return []
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(line, seed)]
    return [digest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])]


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``sizes`` hashes in ``flat``: the bits set in over half of them; zero where there are none."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(flat):
        return out
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(sizes)
    counts = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(counts * 2 > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_batch(batch: list[bytes], words: int, seed: int) -> np.ndarray:
    hashes = [shingle_hashes(t, words, seed) for t in batch]
    return majority(np.array([h for own in hashes for h in own], np.uint64), np.array(list(map(len, hashes)), np.int64))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            fp = fingerprint_batch(utf8(batch.column("text")), words, seed)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each point's component, under the links a - b."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (jump := new[new])).any():
            new = jump
        new = new[label]
        if (new == label).all():
            return label
        label = new


class Forest:
    """Vantage-point trees over ``points`` (uint64), one for each run of equal ``shard``; both sorted by shard.

    With ``label``, points of one label aren't searched for pairs among themselves.
    """

    def __init__(self, points: np.ndarray, shard: np.ndarray, radius: int, label: np.ndarray | None = None):
        self.radius, n = radius, len(points)
        order = np.arange(n)
        low = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        high = np.append(low[1:], n)
        self.root = np.repeat(np.arange(len(low)), high - low)  # of each point
        spans, children, reach, links, count = [], [], [], [], 0
        while len(low):
            size = high - low
            split = size > LEAF
            spans.append(np.stack([low, high], 1))
            kids = np.full((len(low), 2), -1)
            bound = np.zeros((len(low), 2, 2), np.int64)
            at = np.flatnonzero(split)
            count += len(low)
            if len(at):
                own, length = low[at], size[at] - 1
                ends = np.cumsum(length)
                slot = np.arange(ends[-1]) + np.repeat(own + 1 - ends + length, length)
                node = np.repeat(np.arange(len(at)), length)
                away = np.bitwise_count(points[order[slot]] ^ points[order[own]][node]).astype(np.int64)
                near = away <= radius
                links.append((order[slot[near]], order[own][node[near]]))
                by = np.lexsort((away, node))
                order[slot], away = order[slot[by]], away[by]
                first = ends - length
                middle = first + (length + 1) // 2
                bound[at, 0, 0], bound[at, 0, 1] = away[first], away[middle - 1]
                bound[at, 1, 0], bound[at, 1, 1] = away[np.minimum(middle, ends - 1)], away[ends - 1]
                kids[at, 0] = count + 2 * np.arange(len(at))
                kids[at, 1] = kids[at, 0] + 1
                cut_at = own + 1 + (length + 1) // 2
                low, high = np.stack([own + 1, cut_at], 1).ravel(), np.stack([cut_at, own + 1 + length], 1).ravel()
            else:
                low = high = low[:0]
            children.append(kids)
            reach.append(bound)
        self.points, self.order = points, order
        self.span = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        self.kids = np.concatenate(children) if children else np.zeros((0, 2), np.int64)
        self.reach = np.concatenate(reach) if reach else np.zeros((0, 2, 2), np.int64)
        a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
        self.label = components(n, a, b) if label is None else label

    def _search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the queries to points of other components."""
        there = self.label[self.order]
        changes = np.concatenate([[0], np.cumsum(there[1:] != there[:-1])])
        one = changes[self.span[:, 1] - 1] == changes[self.span[:, 0]]
        of_node = np.where(one, there[self.span[:, 0]], -1)
        node, found = self.root[query], []
        while len(query):
            stay = of_node[node] != self.label[query]
            query, node = query[stay], node[stay]
            leaf = self.kids[node, 0] < 0
            q, span = query[leaf], self.span[node[leaf]]
            length = span[:, 1] - span[:, 0]
            ends = np.cumsum(length)
            other = self.order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(span[:, 0] - ends + length, length)]
            q = np.repeat(q, length)
            near = (np.bitwise_count(self.points[q] ^ self.points[other]) <= self.radius) & (self.label[q] != self.label[other])
            found.append((q[near], other[near]))
            query, node = query[~leaf], node[~leaf]
            vantage = self.order[self.span[node, 0]]
            away = np.bitwise_count(self.points[query] ^ self.points[vantage]).astype(np.int64)
            near = (away <= self.radius) & (self.label[query] != self.label[vantage])
            found.append((query[near], vantage[near]))
            into = [(away - self.radius <= self.reach[node, k, 1]) & (away + self.radius >= self.reach[node, k, 0]) for k in (0, 1)]
            query, node = np.concatenate([query[m] for m in into]), np.concatenate([self.kids[node[m], k] for k, m in enumerate(into)])
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of points of one shard, of different labels, within the radius; both ways round."""
        for at in range(0, len(self.points), QUERIES):
            yield self._search(np.arange(at, min(at + QUERIES, len(self.points))))

    def link(self) -> np.ndarray:
        """Component of every point."""
        for at in range(0, len(self.points), QUERIES):
            a, b = self._search(np.arange(at, min(at + QUERIES, len(self.points))))
            if len(a):
                self.label = components(len(self.points), a, b, self.label)
        return self.label


def blocks_of_shards(points: int, radius: int, bits: int = 64) -> int:
    """How many blocks make a shard's key: the least number that leaves ``SHARD_POINTS`` points in an even shard."""
    m = 1
    while m < 4 and points > SHARD_POINTS << (bits * m // (radius + m)):
        m += 1
    return m


def shard_links(prints: DataFrame, radius: int, bits: int = 64, m: int | None = None) -> DataFrame:
    """a, b: a spanning forest of the links among the distinct values of ``prints.fp``, by vantage-point trees."""
    m = m or blocks_of_shards(prints.count(), radius, bits)
    edges = np.linspace(0, bits, radius + m + 1).round().astype(int).tolist()
    block = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    shards = []
    for k, chosen in enumerate(combinations(range(radius + m), m)):
        value = F.lit(0).cast("long")
        for i in chosen:
            value = F.shiftleft(value, edges[i + 1] - edges[i]).bitwiseOR(block[i])
        shards.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    assert len(shards) == comb(radius + m, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None:
            return
        block, value, points = rows["block"].to_numpy(), rows["value"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        by = np.lexsort((points, value, block))
        block, value, points = block[by], value[by], points[by]
        shard = np.cumsum(np.concatenate([[False], (block[1:] != block[:-1]) | (value[1:] != value[:-1])]))
        label = Forest(points, shard, radius).link()
        at = np.flatnonzero(label != np.arange(len(label)))
        yield pa.record_batch([pa.array(points[at].view(np.int64)), pa.array(points[label[at]].view(np.int64))], ["a", "b"])

    dealt = prints.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.block", "s.value", "fp").repartition("block", "value")
    return dealt.mapInArrow(run, "a long, b long")


#: Links of one node beyond which they are dealt out by a salt.
HUB = 10_000


def connected(links: DataFrame, hub: int = HUB) -> DataFrame:
    """node, root: the smallest node of each component, for all nodes of ``links`` (a, b); by alternating stars."""

    def with_least(rows: DataFrame, least: DataFrame, row: str) -> DataFrame:
        if most <= hub:
            return rows.join(least.select("a", "m"), "a")
        return salted_join(rows, least.select("a", "m"), hot_keys(least, "a"), ["a"], [row])

    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, most = None, None
    while True:
        ends = links.select(F.explode(F.array("a", "b")).alias("end"), F.xxhash64("a", "b").cast("decimal(38,0)").alias("h"))
        now = ends.groupBy("end").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
        if (now.n, now.h) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, most = (now.n, now.h), now.most or 0
        # large star: larger neighbours go to the least of the neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, least, "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def component_ids(rows: DataFrame, groups: DataFrame, links: DataFrame, point: str) -> DataFrame:
    """``rows`` with component_id: the least ``first`` of all points that the links reach.

    ``groups``: ``point``, first (smallest doc_id), n (rows of the point); each row has a point.
    Points of very many rows, and components of very many points, are dealt out by salts.
    """
    roots = connected(links)
    known = hot_keys(roots.groupBy("root").agg(F.count("*").alias("n")), "root")
    points = cut(groups.join(roots, groups[point] == roots["node"], "left").select(point, "first", "n", F.coalesce("root", point).alias("root")))
    ids = points.groupBy("root").agg(F.min("first").alias("component_id"))
    of_point = salted_join(points, ids, known, ["root"], [point]).select(point, "component_id")
    return salted_join(rows, of_point, hot_keys(groups.select(point, "n"), point), [point], ["doc_id"])


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4, similar: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links reach).

    With ``similar``, texts link whose sets of shingles have a Jaccard similarity of
    0.8 or more: see ``near_copies``; fingerprints within ``radius`` then are candidates only.
    """
    if similar:
        from docloom.llm.near_copies import near_copies

        return near_copies(docs, words, seed, radius)
    prints = cut(fingerprints(docs, words, seed))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    return component_ids(prints, groups, shard_links(groups, radius), "fp").select("doc_id", "fp", "component_id")
