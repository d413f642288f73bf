import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from docloom.llm import packing as P


def test_choice_is_least():
    rng = random.Random(1)
    packer = P.SumOfSquares(12)
    for _ in range(400):
        n = rng.randint(1, 11)
        level = packer.level.copy()

        def cost(at):
            after = level.copy()
            if at:
                after[at] -= 1
            if at + n < 12:
                after[at + n] += 1
            return int((after[1:12] ** 2).sum())

        options = [0] + [h for h in range(1, 13 - n) if level[h]]
        assert cost(packer.choose(n)) == min(map(cost, options))
        packer.place((0, 0, np.zeros(n, "<u4"), n))


def check(rows, docs, size, end, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for d, t in docs}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0 and at < size
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[d])


def test_whole_tables(spark, odd_docs, no_docs, vocabulary):
    docs = [(i, r.text) for i, r in enumerate(odd_docs.collect())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size in (2048, 16):
        check(P.pack(df, vocabulary, 1, size).collect(), docs, size, 1, vocabulary)
    assert P.pack(odd_docs, vocabulary, 1).filter("doc_id is null").count() >= 2
    assert P.pack(no_docs, vocabulary, 1).count() == 0


def test_most_tokens_stay_where_the_rule_put_them():
    """Documents of real lengths over 16 tasks: what lies in a window as the rule left it, against what was moved to fill one up."""
    import duckdb

    lengths = [n for (n,) in duckdb.connect().execute("SELECT length(text) // 4 + 1 FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id").fetchall()]
    placed = total = 0
    for task in range(16):
        packer, closed = P.SumOfSquares(2048), []
        for doc, n in enumerate(lengths[task::16]):
            for start in range(0, n, 2048):
                closed += packer.place((doc, start, np.zeros(min(2048, n - start), "<u4"), n))
        kept = [{(p[0], p[1], len(p[2])) for p in window} for windows in packer.open.values() for window in windows]
        done = packer.finish()
        for window in closed:
            placed += sum(len(p[2]) for p in window)
        for window in done:
            own = {(p[0], p[1], len(p[2])) for p in window}
            placed += max((sum(n for _, _, n in k) for k in kept if k <= own), default=0)
        fills = [sum(len(p[2]) for p in w) for w in closed + done]
        assert all(f == 2048 or f & (f - 1) == 0 for f in fills) and sum(f < 2048 for f in fills) <= 11
        total += sum(fills)
    assert total == sum(lengths) and placed > 0.95 * total


def test_finish():
    for seed in range(200):
        rng = random.Random(seed)
        packer, out = P.SumOfSquares(16), []
        given = [rng.randint(1, 16) for _ in range(rng.randint(0, 25))]
        for doc, n in enumerate(given):
            out += packer.place((doc, 0, np.arange(n, dtype="<u4"), n))
        out += packer.finish()
        fills = [sum(len(p[2]) for p in w) for w in out]
        assert sum(fills) == sum(given) and all(f == 16 or f & (f - 1) == 0 and f < 16 for f in fills) and sum(f < 16 for f in fills) <= 4
        for doc, n in enumerate(given):
            own = sorted((p for w in out for p in w if p[0] == doc), key=lambda p: p[1])
            assert np.concatenate([p[2] for p in own]).tolist() == list(range(n))
        assert not packer.open and not packer.level.any() and packer.finish() == []
