import hashlib
import random

import numpy as np
import pytest

from docloom.llm import suffix_dedup as S


def brute(docs, width):
    """docs: (doc_id, bytes) -> {doc_id: removed mask}"""
    first = {}
    ordered = sorted(docs)
    for d, (_, t) in enumerate(ordered):
        for i in range(len(t) - width + 1):
            first.setdefault(t[i : i + width], (d, i))
    out = {}
    for d, (key, t) in enumerate(ordered):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] != (d, i):
                gone[i : i + width] = True
        out[key] = gone
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcdefgh " if seed % 2 else "ab"
    passages = ["".join(rng.choices(alphabet, k=rng.randint(80, 400))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts += ["".join(rng.choices(alphabet, k=rng.randint(0, 150))), p[a : a + rng.randint(0, 400)]]
        docs.append((i, "".join(parts)))
    docs.append((n, "z" * 500))
    docs.append((n + 1, "xyz" * 200 + "z" * 150))
    docs.append((n + 2, docs[3][1]))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    text = np.frombuffer("".join(t for _, t in corpus(seed, 8)).encode(), np.uint8)
    raw, sa = text.tobytes(), S.suffix_array(text, 100)
    assert sorted(sa.tolist()) == list(range(len(text)))
    heads = [raw[i : i + 100] for i in sa]
    assert heads == sorted(heads)
    places = np.arange(1, len(sa))
    for r, n in zip(places, S.common_prefixes(text, sa, places)):
        a, b = raw[sa[r] :], raw[sa[r - 1] :]
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed,shard,hot", [(1, 1 << 20, 2000), (2, 3000, 2000), (3, 2000, 3), (4, 1500, 2)])
def test_against_brute_force(spark, seed, shard, hot):
    docs = corpus(seed)
    want = brute([(d, t.encode()) for d, t in docs], 100)
    rows = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shard=shard, many=hot).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = dict(docs)[r.doc_id].encode()
        kept = bytes(np.frombuffer(raw, np.uint8)[~want[r.doc_id]])
        assert bytes(r.kept) == kept, (r.doc_id, r.n_removed, int(want[r.doc_id].sum()))
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), len(raw) - len(kept), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == len(S.spans(want[r.doc_id])[0])


def test_odd_rows(odd_docs, no_docs):
    rows = S.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[200].n_bytes == by[201].n_bytes == 0
    assert by[101].n_removed in (0, by[101].n_bytes)
    assert by[203].n_bytes == 9000 and by[203].n_removed == 8999
    assert S.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed,shard,hot", [(1, 1 << 20, 2000), (3, 1500, 2000), (4, 1500, 2)])
def test_repeated_and_shared_ids(spark, seed, shard, hot):
    docs = corpus(seed)
    docs = [(None if d % 5 == 0 else d - d % 3 if d % 7 == 0 else d, t) for d, t in docs]
    rows = spark.createDataFrame(docs + docs[::2] + docs[::3], "doc_id long, text string").repartition(7)
    order = {(r.doc_id, r.text): (S.NONE if r.doc_id is None else r.doc_id, r.sub) for r in rows.selectExpr("*", "xxhash64(text) AS sub").collect()}
    gone = brute([(k, t.encode()) for (_, t), k in order.items()], 100)
    left = lambda d, t: bytes(np.frombuffer(t.encode(), np.uint8)[~gone[order[d, t]]])
    want = sorted(((d, t, left(d, t)) for d, t in docs + docs[::2] + docs[::3]), key=repr)
    got = S.remove_repeats(rows, shard=shard, many=hot).select("doc_id", "n_bytes", "kept").collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == sorted(((d, len(t.encode()), k) for d, t, k in want), key=repr)


def test_long_documents(spark):
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    docs = [(1, "".join(rng.choices("ab", k=9000)) + passage), (2, passage * 12 + "q" * 5000 + passage[100:600]), (3, "x" * 150), (4, "".join(rng.choices("abcdefgh ", k=20_000)) + passage[:99])]
    want = brute([(d, t.encode()) for d, t in docs], 100)
    for shard in (500, 1500):
        got = {r.doc_id: (bytes(r.kept), r.n_spans) for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard=shard).collect()}
        assert got == {d: (bytes(np.frombuffer(t.encode(), np.uint8)[~want[d]]), len(S.spans(want[d])[0])) for d, t in docs}


@pytest.mark.parametrize("combine", [1, 50])
def test_runs_of_one_task(spark, combine):
    docs = corpus(5, 40)
    rows = spark.createDataFrame(docs + docs[::3], "doc long, text string").selectExpr("doc", "xxhash64(text) AS sub", "text").coalesce(1)
    few = S.sort_out(S.shard_runs(rows, shard=800, combine=combine)).filter("kind = 0").select("doc", "start", "n").distinct().collect()
    many = S.sort_out(S.shard_runs(rows, shard=800, combine=1 << 30)).filter("kind = 0").select("doc", "start", "n").distinct().collect()
    places = lambda found: {(r.doc, r.start + k) for r in found for k in range(r.n)}
    assert places(few) == places(many) != set()
