import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import rule_ledger as R

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed", "kept")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, chars, symbols, dup, again = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)
    fails = [n < 20, 100 * again > 30 * n, chars < 2 * n or chars > 15 * n, 10 * symbols > n, dup >= 3 and 100 * dup > 30 * len(lines)]
    return n, chars, symbols, len(lines), dup, again, sum(1 << i for i, x in enumerate(fails) if x)


def test_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(3)
    some = [" ".join(rng.choices("ab cd é ☃ x# | \v\f".split(" "), k=rng.randint(0, 120))) + "\n" * rng.randint(0, 3) + "line here\nline here\n \nline here " for _ in range(150)]
    some += ["a " * 9, "a " * 8, "a b c d e f g h " * 2, "\x1c\x85\xa0 u", "\n".join(["one two three four five six seven eight nine ten"] * 3)]
    odd = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(some)], "doc_id long, text string"))
    got = R.verdict(R.ledger(odd), R.POLICIES[3]).select(*COLUMNS).collect()
    want = [(r.doc_id, *(x := brute(r.text)), x[-1] == 0) for r in odd.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({w[-2] for w in want}) > 5
    assert R.ledger(no_docs).count() == 0


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 30, 7, 9, 5)], "doc_id long, text string, n_words int, failed int, _text int")
    assert R.ledger(docs).select("doc_id", "n_words", "failed").first() == (1, 30, 2)


def test_slices_and_batches(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "bb", "ccc"], k=rng.randint(0, 400))).encode() for _ in range(40)] + [b"x" * 5000, b""]
    want = [brute(t.decode())[5] for t in texts]
    assert R.repeated_words(texts).tolist() == want
    monkeypatch.setattr(R, "SLICE", 64)
    assert R.repeated_words(texts).tolist() == want
    monkeypatch.setattr(R, "BATCH", 500)
    assert np.concatenate([R.repeated_words(p) for p in R._batches(texts)]).tolist() == want


def test_a_text_of_64_megabytes(spark):
    unit = "".join(f"word{i} " for i in range(1000))
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", f"repeat('{unit}', {(64 << 20) // len(unit)}) as text")
    row = R.ledger(docs).first()
    assert row.n_words == row.n_repeat_words == 1000 * ((64 << 20) // len(unit)) and row.failed == 2


def test_policies_and_ablations(spark, odd_docs, no_docs):
    held = R.ledger(odd_docs)
    rows = [brute(r.text)[-1] for r in odd_docs.collect()]
    want = []
    for version, policy in R.POLICIES.items():
        own = R.mask(policy.rules)
        for rule in policy.rules:
            bit = R.mask([rule])
            kept, alone = sum(not x & own for x in rows), sum(x & own == bit for x in rows)
            want.append((version, rule, len(rows), kept, sum(bool(x & bit) for x in rows), alone, kept + alone))
    got = R.ablations(held).select("version", "rule", "n_docs", "n_kept", "n_failed", "n_alone", "n_kept_without").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {tuple(r)[2:] for r in R.ablations(R.ledger(no_docs)).select("version", "rule", "n_docs", "n_kept", "n_failed", "n_alone", "n_kept_without").collect()} == {(0, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        R.mask(["no such rule"])
    with pytest.raises(ValueError):
        R.ledger(odd_docs, [R.Rule(f"r{i}", "n_words < 1") for i in range(64)])
