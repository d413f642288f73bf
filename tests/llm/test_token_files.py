import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import token_files as T


def brute(ids, separator):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("dtype,block", [("<u2", 4), ("<u2", 1), ("<u4", 7), ("<u4", 1000)])
def test_scan(spark, tmp_path, dtype, block):
    rng = np.random.default_rng(block)
    want = {}
    for k, size in enumerate([0, 1, 5, 64, 300]):
        ids = rng.integers(0, 6, size)
        if k == 4:
            ids[100:250] = 3  # a document over many blocks
        ids.astype(dtype).tofile(tmp_path / f"f{k}.bin")
        want[f"f{k}.bin"] = brute(ids.tolist(), 5)
    got = {}
    for r in T.scan_token_files(spark, str(tmp_path), 5, dtype, block).orderBy("file", "ordinal").collect():
        got.setdefault(r.file, []).append((r.start, r.n_tokens, r.closed))
        assert r.ordinal == len(got[r.file]) - 1
    assert got == {k: v for k, v in want.items() if v}


def test_counts(spark, odd_docs, no_docs, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    rows = T.token_counts(odd_docs.repartition(3), vocabulary, 50256).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == want
    assert T.token_counts(no_docs, vocabulary, 50256).count() == 0


@pytest.mark.parametrize("dtype,separator", [("<u2", 50256), ("<u2", 257), ("<u2", 0), ("<u4", 50256), ("<u4", 0), ("<u4", 512)])
def test_scan_by_splits(spark, tmp_path, dtype, separator):
    """Files are read by splits that begin between the bytes of ids, where ids look like separators between their own."""
    mark = separator.to_bytes(2, "little")
    near = [separator, int.from_bytes(mark[::-1], "little"), mark[0] << 8 | 7, 7 << 8 | mark[1], mark[0], mark[1] << 8 | mark[1], 0xBBEF, 0x01BF]
    ids = np.random.default_rng(separator).choice(near, 3000)
    files = {"a": ids, "b": ids[:-1], "c": ids[:1], "d": [0xBBEF, 0x01BF, *ids[:40], separator], "e": [0xBBEF, 0x01BF, 7], "f": [0xBFBBEF if dtype == "<u4" else 7, separator]}
    for name, x in files.items():
        np.array(x).astype(dtype).tofile(tmp_path / name)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for split in (97, 128, 1 << 20):
            for k in kept:
                spark.conf.set(k, str(split))
            got = T.scan_token_files(spark, str(tmp_path), separator, dtype, 5).orderBy("file", "ordinal").collect()
            for name, x in files.items():
                assert [(r.ordinal, r.start, r.n_tokens, r.closed) for r in got if r.file == name] == [(i, *y) for i, y in enumerate(brute(list(x), separator))], (name, split)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_files_have_any_size(spark, tmp_path):
    """Spark's reader of whole files refuses this one, as it did files of 2 GB; the scan doesn't hold it."""
    ids = np.random.default_rng(3).integers(0, 900, 400_000)
    ids.astype("<u2").tofile(tmp_path / "f.bin")
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        got = T.scan_token_files(spark, str(tmp_path), 5).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)
    assert [(r.start, r.n_tokens, r.closed) for r in got] == brute(ids.tolist(), 5)


def test_size_is_no_multiple(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"\x05\x00\x05")
    with pytest.raises(Exception, match="multiple"):
        T.scan_token_files(spark, str(tmp_path), 5).collect()
