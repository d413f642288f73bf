"""Chunkers against plain re-statements of their rules, and properties that must hold for any text."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.functions import chunking as C
from docloom.operators import boundaries as B

texts = st.text(alphabet="ab .!?\n|#-*é漢", max_size=400)
once = settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

SAMPLES = ["", "a", "one. two. three\nfour " * 20, "x" * 95, "\n\n".join("p" * n for n in (5, 30, 9, 60, 1, 1)), "# A\nbody\n# B\n" + "line\n" * 12, ". . ", "a. b\n\nc"]


def sentence_chunks(paragraph, size):
    out, now, n = [], "", 0
    for s in paragraph.replace(". ", ".\n").split("\n"):
        if len(s) > size:
            out += [now] * bool(now) + [s[i : i + size] for i in range(0, len(s), size)]
            now, n = "", 0
        elif n + len(s) > size:
            out += [now] * bool(now)
            now, n = s, len(s)
        else:
            now, n = (f"{now} {s}" if now else s), n + len(s) + 1
    return out + [now] * bool(now)


def paragraph_chunks(text, size):
    out, now, n = [], "", 0
    for p in text.split("\n\n"):
        if len(p) > size:
            out += [now] * bool(now) + sentence_chunks(p, size)
            now, n = "", 0
        elif n + len(p) > size:
            out += [now] * bool(now)
            now, n = p, len(p)
        else:
            now, n = (f"{now}\n\n{p}" if now else p), n + len(p)
    return out + [now] * bool(now)


def heading_chunks(text, size):
    out, now, n = [], "", 0
    for line in text.split("\n"):
        if line.startswith("#") and now:
            out.append(now)
            now, n = "", 0
        now, n = now + line + "\n", n + len(line) + 1
        if n > size:
            out.append(now)
            now, n = "", 0
    return out + [now] * bool(now)


def test_packers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, text string")
    rows = df.select("i", C.paragraph_chunks(F.col("text"), 40).alias("p"), C.sentence_chunks(F.col("text"), 40).alias("s"), C.heading_chunks(F.col("text"), "#", 40).alias("h"), C.windows(F.col("text"), 10, 3).alias("w"), C.spans(F.col("text"), 7).alias("f"), C.spans_at(F.col("text"), r"\n", 20).alias("l"))
    for r in rows.collect():
        t = SAMPLES[r.i]
        assert r.p == paragraph_chunks(t, 40) and r.s == sentence_chunks(t, 40) and r.h == heading_chunks(t, 40)
        assert r.w == [t[i : i + 10] for i in range(0, len(t), 7)]
        for own in (r.f, r.l):
            assert [x.start for x in own] == [0, *(x.end for x in own)][: len(own)] and sum(x.end - x.start for x in own) == len(t)


def test_overlapping_sentences(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(12))
    (chunks,) = spark.createDataFrame([(text,)], "text string").select(C.overlapping_sentences(F.col("text"), 100)).first()
    assert all(s in " ".join(chunks) for s in re.findall(r"Sentence number \d+ ends here\.", text))
    for a, b in zip(chunks, chunks[1:]):
        assert any(a.endswith(b[:k]) for k in range(20, len(b)))


@once
@given(texts)
def test_spans_tile(text):
    for own in (B.enhanced_spans(text, 40, 5, 80), B.spans_by(B.SENTENCE, text, 30)):
        assert "".join(text[a:b] for a, b in own) == text and all(a < b for a, b in own)


@once
@given(texts)
def test_pieces_join(text):
    assert "".join(B.recursive_pieces(text, 25)) == text and all(len(p) <= 25 for p in B.recursive_pieces(text, 25))
    assert "".join(B.list_pieces(text, 30)) == text
    assert B.diff_sections(text, text) == []


def test_code_and_sections():
    code = "```python\n" + "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(30)) + "\n```"
    pieces = B.code_pieces(code, 200)
    assert len(pieces) > 3 and all(p.startswith("```python\n") and p.endswith("\n```") and len(p) <= 210 for p in pieces)
    assert "".join(re.sub(r"\s", "", p[9:-3]) for p in pieces) == re.sub(r"\s", "", code[9:-3])
    assert B.semantic_sections("# A\ntext\n```\n# no heading\n```\n# B\nmore", 20) == ["# A\ntext\n```\n# no heading\n```", "# B\nmore"]
    assert B.generic_sections("Intro:\nbody one\nbody two\nNEXT\nlast words here") == [{"heading": "Intro:", "text": "body one\n\nbody two"}, {"heading": "NEXT", "text": "last words here"}]
    assert B.diff_sections("a\nb\nc", "a\nx\nb\nc") == ["x\nb\nc"]


def test_a_table_has_a_separator_row():
    kinds = lambda text: [b["type"] for b in B.boundaries(text)]
    assert "table" in kinds("x\n|a|b|\n|---|:-:|\n|1|2|\n|3|4|\n") and "table" not in kinds("|a|b|\n|1|2|\n")
