import hashlib
import random
import re

from docloom.llm import exact_dedup as E, line_dedup as L


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    out = []
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for i, r in enumerate(own):
            out.append((r.doc_id, own[0].doc_id, len(own), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_exact(df):
    return sorted(map(tuple, E.content_sort(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact(odd_docs, no_docs):
    assert got_exact(odd_docs) == brute_exact(odd_docs.collect())
    assert E.content_sort(no_docs).count() == 0


def test_exact_with_a_very_large_group(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["the same  text", "the same text", "the sametext\n "])) for i in range(900)]
    rows += [(1000 + i, f"text {rng.randint(0, 60)}") for i in range(300)] + [(2000 + i, "x" * i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got_exact(df) == brute_exact(df.collect())


def brute_lines(rows, sites):
    spread = {}
    strip = lambda x: x.strip(" \t\n\v\f\r")
    for r in rows:
        for line in (r.text or "").split("\n") if r.text is not None else []:
            spread.setdefault(strip(line), set()).add(r.source)
    gone = {line for line, own in spread.items() if line and len(own) >= (sites if len(line) >= 20 else 2 * sites)}
    out = []
    for r in rows:
        lines = [] if r.text is None else r.text.split("\n")
        kept = [x for x in lines if strip(x) not in gone]
        out.append((r.doc_id, None if r.text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark, odd_docs, no_docs):
    rng = random.Random(4)
    common = [f"this line is boilerplate number {i:02}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(common, k=rng.randint(0, 4)) + [f"own line of document {i} here", "  " + rng.choice(common) + " ", "short"]), f"site{rng.randint(0, 40)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (5, 12, 18):
        got = sorted(map(tuple, L.remove_spread_lines(df, sites).select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)
        assert got == brute_lines(df.collect(), sites)
    got = L.remove_spread_lines(odd_docs, 2)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == brute_lines(odd_docs.collect(), 2)
    assert L.remove_spread_lines(no_docs, 2).count() == 0


def test_short_lines(spark):
    rows = [(i, "\n".join(["ten chars!", " ten chars!\t", f"own {i}", "", "on few"] if i < 9 else ["ten chars!", f"a line of its own, number {i}"]), f"site{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in L.remove_spread_lines(df, 5).collect()}
    assert got[3] == ("own 3\n\non few", 2) and got[20] == ("a line of its own, number 20", 1)


def test_columns_with_the_same_names(spark):
    line = "a line that every site has, of course"
    rows = [(i, f"{line}\nown {i}", f"s{i}", 7, "x", [1], i, 5, 6) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row1 int, _gone string, _row2 array<int>, n_lines long, line_no int, h1 int")
    got = L.remove_spread_lines(df, 5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r._row1, r._gone, r._row2, r.n_lines, r.n_removed, r.line_no, r.h1) for r in got] == [(i, f"own {i}", 7, "x", [1], 2, 1, 5, 6) for i in range(6)]
