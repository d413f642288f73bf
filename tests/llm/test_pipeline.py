import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from docloom.llm.common import table


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def kept_of_near_copies(rows):
    """The smallest doc_id of each component of texts with a similarity of 0.8 or more, by comparing all pairs."""
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def without_repeats(rows, width=100):
    """Each text without the bytes that a string of 100 bytes covers that also starts earlier; whole characters of what is left."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = True
            seen.add(window)
        out[r.doc_id] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def without_boilerplate(rows, sites=5):
    blank, where = " \t\n\v\f\r", {}
    for r in rows:
        for line in r.text.split("\n"):
            where.setdefault(line.strip(blank), set()).add(r.source)
    gone = {x for x, own in where.items() if x and len(own) >= (sites if len(x) >= 20 else 2 * sites)}
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(blank) not in gone) for r in rows}


def test_stages_against_brute_force(spark, tmp_path, vocabulary):
    folder = "/root/testdata/sf0.001"
    docs, kept = table(spark, folder, "documents"), {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    rows = {name: df.collect() for name, df in kept.items()}
    whole = {r.doc_id: r for r in table(spark, folder, "documents").collect()}
    toxic = {r.doc_id for r in table(spark, folder, "labels").collect() if r.toxic == 1}
    clean = {r.doc_id for r in table(spark, folder, "labels").collect() if r.toxic == 0}
    left = {r.doc_id for r in rows["toxicity"]}
    assert all(r.text == whole[r.doc_id].text for r in rows["toxicity"]) and len(clean - left) <= 0.02 * len(clean)
    assert len(toxic - left) > 0  # eleven labelled ones are few to learn from; test_toxicity looks at recall
    assert {r.doc_id: r.text for r in rows["line dedup"]} == without_boilerplate(rows["toxicity"])
    assert {r.doc_id for r in rows["SimHash near-dedup"]} == kept_of_near_copies(rows["line dedup"])
    before = {r.doc_id: r.text for r in rows["line dedup"]}
    assert all(r.text == before[r.doc_id] for r in rows["SimHash near-dedup"])
    assert {r.doc_id: r.text for r in rows["suffix-array dedup"]} == without_repeats(rows["SimHash near-dedup"])
    assert all(r.n_chars == len(r.text) for r in rows["suffix-array dedup"])
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_padding(), tokenizer.no_truncation()
    tokens = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, P.END_OF_DOCUMENT] for r in rows["suffix-array dedup"]}
    pieces, sequences = {}, {}
    for r in rows["packing"]:
        own = tokens[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(tokens[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, sizes in ((pieces, {d: len(t) for d, t in tokens.items()}), (sequences, None)):
        for key, own in parts.items():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1].tolist()] and (ends[-1] == sizes[key] if sizes else ends[-1] <= 2048)
    assert pieces.keys() == tokens.keys()
    assert {r.doc_id: r.n for r in P.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {d: len(t) for d, t in tokens.items()}


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for source in (odd_docs, no_docs):
        docs = source
        for i, (name, stage) in enumerate(P.STAGES):
            path = f"{tmp_path}/{id(source)}-{i}"
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (source is odd_docs)


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    words = [f"w{i}" for i in range(400)]
    own = [" ".join(words[i : i + 40]) for i in range(0, 400, 40)]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (7, own[3]), (7, own[4]), (7, own[4]), (9, own[0]), (8, own[5]), (None, None), (10, ""), (None, own[2])]
    docs = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, "").collect()
    want = [(9, own[0]), (None, own[1]), (None, own[2]), (7, own[3]), (7, own[4]), (8, own[5]), (10, "")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)
