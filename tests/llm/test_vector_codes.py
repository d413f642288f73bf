import hashlib
import math
import random

import numpy as np
import pytest

from docloom.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id, label, code, error, by exhaustive search in Python's whole numbers; and the final entries."""
    kept = [(k, [math.floor(scale * x) for x in v], g) for k, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1]) // parts
    cut = [[v[i * d : (i + 1) * d] for i in range(parts)] for _, v, _ in kept]
    books = [[list(c[i]) for c in cut[:entries]] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda i, x: min(range(len(books[i])), key=lambda e: (far(x, books[i][e]), e))
    for _ in range(rounds):
        for i in range(parts):
            own = [near(i, c[i]) for c in cut]
            for e in range(len(books[i])):
                if mine := [c[i] for c, o in zip(cut, own) if o == e]:
                    books[i][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (k, _, g), c in zip(kept, cut):
        codes = [near(i, c[i]) for i in range(parts)]
        out.append((k, g, bytes(codes).hex(), sum(far(c[i], books[i][e]) for i, e in enumerate(codes))))
    return out, books


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")


def same(trained, rows, **how):
    want, books = brute(rows, **how)
    got = [tuple(r) for r in trained.coded.select("vec_id", "label", "code", "error").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in trained.codebooks if b.size] == books
    if books:
        assert trained.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_against_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.3) for _ in range(32)] for _ in range(9)]
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f([x + rng.gauss(0, 0.05) for x in rng.choice(centres)]), rng.choice([None, 1, 2])) for i in range(600)]
    rows += [(900 + i, rows[7][1], 3) for i in range(30)] + [(5, rows[8][1], 1), (None, rows[9][1], None), (0, rows[0][1], 5), (0, rows[1][1], 5)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] + [0.0] * 31, 1), (2003, [float("nan")] + [0.0] * 31, 1), (2004, [float("-inf")] + [0.0] * 31, 1)]
    trained = V.train(frame(spark, rows).repartition(5))
    same(trained, rows)
    # the bounds save most distances once entries move little
    assert trained.compared[0][0] >= trained.compared[0][1] and trained.compared[-1][0] < 0.5 * trained.compared[-1][1]
    again = V.with_group_error(trained.coded).collect()
    sums = {}
    for r in again:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in again) and len(again) == len(rows) - 5


def test_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) / 4096 for _ in range(16)], 1) for i in range(300)]  # distances of few values: many ties
    same(V.train(frame(spark, rows, "array<double>").repartition(3), n_groups=3), rows)
    one = [(i, [0.25] * 8, None) for i in range(40)]
    same(V.train(frame(spark, one)), one)
    few = [(3, [0.5] * 8, 1), (1, [-0.5] * 8, 1), (2, [0.4] * 8, 1)]
    same(V.train(frame(spark, few)), few)
    large = [(i, [rng.uniform(-900, 900) for _ in range(8)], 1) for i in range(100)]
    same(V.train(frame(spark, large, "array<double>"), parts=2, entries=5, rounds=3), large, parts=2, entries=5, rounds=3)


def test_nothing_and_errors(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1), (2, [None] * 8, None)]):
        trained = V.train(frame(spark, rows))
        assert V.with_group_error(trained.coded).count() == 0 and trained.digest() == hashlib.sha256(b"").hexdigest()
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            V.train(frame(spark, rows))


def test_extra_columns(spark):
    rows = [(i, [i / 40] * 8, i % 2) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int, _x int")
    same(V.train(df), rows)


def test_rows_of_a_common_label(spark):
    rows = [(i, [((i * 7) % 100) / 100] * 8, 1 if i % 3 else None) for i in range(3000)]
    coded = V.with_group_error(V.train(frame(spark, rows, "array<double>")).coded)
    assert coded.count() == 3000 and coded.select("label", "label_error").distinct().count() == 2


def test_groups():
    book = np.array([[0, 0], [1, 0], [50, 50], [51, 50], [0, 90]])
    own = V.groups_of(book, 3)
    assert own[0] == own[1] != own[2] == own[3] != own[4] and own.max() == 2
    assert V.groups_of(np.zeros((4, 2), int), 3).max() == 0
