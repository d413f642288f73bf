import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe

PIECES = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "-", "<|endoftext|>", "漢", "\x1c", "\x85", "\u00a0", "́", "'d", "'S", "\r\n", "\x00", "😀"]


@pytest.fixture(scope="module")
def reference(vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def codec(vocabulary):
    return bpe.Codec(vocabulary)


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 16))) for _ in range(1500)]
    return [*made, "", "a" * 3000, "ab" * 500 + " " * 200, "é" * 300, "<|endoftext|>", "x<|endoftext|>  <|endoftext|>", "it's  don't've " * 9]


def test_equals_the_library(codec, reference):
    batch = texts()
    got = [ids for i in range(0, len(batch), 400) for ids in codec.encode_many(batch[i : i + 400])]
    for text, ids in zip(batch, got, strict=True):
        want = reference.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_forgetting_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    monkeypatch.setattr(bpe, "LONG", 8)
    codec = bpe.Codec(vocabulary)
    for text in texts()[:200] + ["pneumonoultramicroscopicsilicovolcanoconiosis" * 4]:
        assert codec.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_forced_boundaries(codec):
    inside = {pair for token in codec.tokens for pair in zip(token, token[1:])} - {pair for s in codec.special for pair in zip(s.encode(), s.encode()[1:])}
    assert {tuple(p) for p in np.argwhere(codec.joined).tolist()} >= inside
    assert not codec.joined.all()


def test_odd_rows(spark, odd_docs, no_docs, vocabulary, reference):
    rows = bpe.round_trip(odd_docs, vocabulary).collect()
    assert len(rows) == odd_docs.count()
    encoded = bpe.encode(odd_docs, vocabulary)
    back = bpe.decode(encoded, vocabulary)
    texts_of = sorted(r.text or "" for r in odd_docs.collect())
    assert sorted(r.text for r in back.collect()) == texts_of
    assert sorted(len(r.ids) // 4 for r in encoded.collect()) == sorted(len(reference.encode(t, add_special_tokens=False).ids) for t in texts_of)
    assert bpe.round_trip(no_docs, vocabulary).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_pieces_of_equal_hash(codec, reference):
    rng = random.Random(9)
    batch = [t for n in (512, 1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n, "b", "a"), "x " + thue_morse(n, "b", "a") + " " + thue_morse(n))]
    batch += ["".join(rng.choices("abcdeé", k=rng.randint(1, 90))) for _ in range(500)]
    for _ in range(2):  # new, then known pieces
        for text, ids in zip(batch, codec.encode_many(batch), strict=True):
            assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
            assert codec.decode(ids) == text


def test_digests(spark, odd_docs, vocabulary, reference):
    odd = [(1000 + i, t) for i, t in enumerate([thue_morse(1024), thue_morse(1024, "b", "a"), *texts()[:200]])]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = []
    for r in docs.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, vocabulary).collect()), key=repr) == sorted(want, key=repr)
