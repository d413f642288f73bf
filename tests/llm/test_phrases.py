import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import phrases as P


def brute(rows, min_count, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = found.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        listed = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(rng, n, words):
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    return [rng.choice([". ", "\n", ", ", "! ", "\t", " "]).join(line() for _ in range(rng.randint(0, 6))) for _ in range(n)]


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("depths", [(1, 1, 2), (4,), (1, 1, 1, 1), (2, 2)])
def test_against_brute_force(spark, depths):
    rng = random.Random(sum(depths) * len(depths))
    words = "the The OF of a b c new york é É ñ x-y \x1c \x85 <p> 1".split(" ") + ["und"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts(rng, 160, words)]
    rows += [("en", "new york city hall " * 40), ("en", None), ("fr", ""), (None, None), ("de", "x " * 300), ("en", "..,,;;")] + [rows[0]] * 5
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert got(P.collocations(docs, 6, 40, depths, shard_bytes=1500)) == brute(rows, 6, 40)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert got(P.collocations(odd_docs, 3, 500)) == brute(rows, 3, 500)
    assert P.collocations(no_docs, 1, 10).count() == 0
    assert P.collocations(odd_docs, 10**6, 10).count() == 0


def test_extra_columns(spark):
    docs = spark.createDataFrame([("en", "a b a b", 1, "x")], "lang string, text string, n int, shard string")
    assert [r.phrase for r in P.collocations(docs, 2, 5).collect()] == ["a b"]


def test_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("en", " ".join(texts(rng, 60, list("abcdef")))), ("en", "a b c " * 900), ("en", "a b" * 3000 + ". c d " * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 5, 100)
    assert got(P.collocations(docs, 5, 100)) == want
    monkeypatch.setattr(P, "SLICE", 100)
    words = [(w, e) for t in rows for w, e in P.slices(t[1].encode())]
    assert sum(len(w) for w, _ in words) > 1000 and not all(e for _, e in words)
    assert [w.decode() for own, _ in words for w in own] == [w for t in rows for w in t[1].replace(".", " A ").replace(",", " A ").replace("\n", " A ").replace("!", " A ").split()]


def test_a_text_of_64_megabytes(spark):
    unit = "one two three four. "
    n = (64 << 20) // len(unit)
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr("'en' as lang", f"repeat('{unit}', {n}) as text")
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in P.collocations(docs).collect()] == [("one two three four", n, n, n, 4 * n)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_bitmaps(monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    at = rng.integers(0, 5, 700).astype(np.int32)
    at[60:140] = 3  # runs over the ends of blocks
    for depth in (1, 2, 3):
        want = Counter()
        for k in range(1, depth + 1):
            want.update(tuple(at[i : i + k + 1].tolist()) for i in range(len(at) - k) if at[i : i + k + 1].all())
        made = Counter()
        for path, counts, nodes in P.descend(at, depth):
            for p, c in zip(path.tolist(), counts.tolist()):
                assert tuple(p) not in made
                made[tuple(p)] = c
            if nodes is not None:
                entry, pos = nodes.positions()
                assert len(pos) == counts.sum() and np.bincount(nodes.owner[entry]).tolist() == counts.tolist()
                assert all(at[q - depth : q + 1].tolist() == path[nodes.owner[e]].tolist() for e, q in zip(entry, pos))
        assert made == want
