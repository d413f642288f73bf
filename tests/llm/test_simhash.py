import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import simhash as S


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    dense = rng.getrandbits(64)
    return out + [dense ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(n // 2)]


@pytest.mark.parametrize("seed", range(3))
def test_forest(seed):
    prints = sorted(set(clustered(250, seed)))
    label = S.Forest(np.array(prints, np.uint64), np.zeros(len(prints), int), 4).link()
    assert label.tolist() == brute_components(prints, 4)
    assert len(S.Forest(np.zeros(0, np.uint64), np.zeros(0, int), 4).link()) == 0


@pytest.mark.parametrize("m", [1, 2, 3])
def test_components_in_spark(spark, m):
    prints = [p if p < 2**63 else p - 2**64 for p in clustered(200, 9)]
    want = brute_components([p & (2**64 - 1) for p in prints], 4)
    links = S.connected(S.shard_links(spark.createDataFrame([(p,) for p in prints], "fp long").distinct(), 4, m=m))
    root = {r.node: r.root for r in links.collect()}
    got = [root.get(p, p) for p in prints]
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


@pytest.mark.parametrize("hub", [1, 10_000])
def test_chain_of_components(spark, hub):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, i) for i in range(21, 400)] + [(1000, 2000), (3000, 2000), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in S.connected(links, hub).collect()} == {(i, 0) for i in range(1, 400)} | {(2000, 1000), (3000, 1000)}


def test_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(odd_docs).collect()), key=repr)
    prints = [brute_fingerprint(r.text) for r in rows]
    part = brute_components(prints, 4)
    least = {}
    for r, p in zip(rows, part):
        ids = [x.doc_id for x, q in zip(rows, part) if q == p and x.doc_id is not None]
        least[p] = min(ids) if ids else None
    assert got == sorted(((r.doc_id is None, r.doc_id or 0, f, least[p]) for r, f, p in zip(rows, prints, part)), key=repr)
    assert S.near_duplicates(no_docs).count() == 0
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == S.shingle_hashes(b"A b C d", 4, 42)[0]
