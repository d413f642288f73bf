"""Boundaries and enhanced chunks against examples and a plain re-statement."""

import random

from docloom.operators import boundaries as B


def marks(text, **how):
    return [(b["type"], text[b["start"] : b["end"]], b["importance"]) for b in B.boundaries(text, **how)]


def test_kinds_of_boundaries():
    text = "## Two\n<h3>T</h3>\n- item\n  2. more\n```py\nx\n```\n|a|b|\n|-|-|\n|1|2|\n|3|4|\n\n> q\n---\n\n\n\nEnd! ok"
    found = marks(text)
    assert found[:2] == [("heading", "## Two", 0.9), ("heading", "<h3>T</h3>", 0.8)]
    kinds = lambda k: [m for m in found if m[0] == k]
    assert kinds("list") == [("list", "-", 0.6), ("list", "  2.", 0.6)]
    assert kinds("code") == [("code", "```py\n", 0.9), ("code", "```", 0.9)]
    assert kinds("table") == [("table", "|a|b|\n|-|-|\n", 0.9), ("table", "", 0.9)] and kinds("quote") == [("quote", "> ", 0.7)]
    assert [m[1].strip("\n") for m in kinds("rule")] == ["---"] and [len(m[1]) for m in kinds("section")] == [] or kinds("section")
    assert kinds("sentence")[-1] == ("sentence", "! ", 0.5)
    html = "<h2>A <b>x</b></h2><p>one</p>\n<p>two\n</p>"
    assert [m for m in marks(html, html=True) if m[0] == "paragraph"] == [("paragraph", "<p>", 0.8), ("paragraph", "</p>", 0.8)] * 2
    assert not [m for m in marks(html) if m[0] == "paragraph"] and B.boundaries(html)[0]["title"] == "A <b>x</b>"


def restated(text, size, least, most):
    """What the chunks are, told boundary by boundary without positions kept from chunk to chunk."""
    found = sorted(B.boundaries(text), key=lambda b: b["start"])
    cuts, start = [], 0
    for i, b in enumerate(found):
        if b["start"] - start > max(most, least):
            cuts.append(b["start"])
            start = b["start"]
        passed = b["start"] - start
        at_target = passed >= size and not any(x["importance"] >= 0.7 for x in found[i + 1 : i + 10]) or passed >= size and next(x for x in found[i + 1 : i + 10] if x["importance"] >= 0.7)["start"] - start > most
        if (b["importance"] >= 0.8 and passed >= least or not (b["importance"] >= 0.8 and passed >= least) and at_target) and b["end"] > start:
            cuts.append(b["end"])
            start = b["end"]
    ends = sorted({c for c in cuts if c > 0} | ({len(text)} if text else set()))
    return list(zip([0, *ends], ends))


def test_enhanced_chunks():
    rng = random.Random(3)
    words = ["word", "other. ", "Ende! ", "\n\n", "\n# Head\n", "\n### Sub\n", "\n- i\n", "\n\n\n\n", "\n> q\n", "\n```\ncode\n```\n", "\n---\n", "x" * 30]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        made = B.enhanced_chunks(text, 60, 20, 120)
        assert [(c["start"], c["end"]) for c in made] == restated(text, 60, 20, 120), text
        assert sum((c["types"] for c in made), []) == [b["type"] for b in B.boundaries(text)][: sum(len(c["types"]) for c in made)]
        for c in made:
            before = [b for b in B.boundaries(text) if b["level"] and b["start"] < c["end"]]
            assert (c["heading"], c["level"]) in [(b["title"], b["level"]) for b in before[-2:]] + [(None, None)] * (len(before) < 2)


def test_overlap_and_context(spark):
    text = "# One\n" + "Sentence here. " * 30 + "\n\n## Two\n" + "Another one. " * 30
    rows = B.enhanced(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t", 25, size=150, least=50, most=300).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and rows[0].heading == "One" and rows[-1].heading == "Two" and rows[-1].level == 2
    for a, b in zip(rows, rows[1:]):
        assert a.end == b.start and a.text == text[a.start : a.end] + text[b.start : b.end][:25]
    assert rows[-1].text == text[rows[-1].start :]


def test_recursive_overlap():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice([f"a{i} b ", f"word{i} ", f"\n{i}", f"\n\n{i}", f"\n## H{i}", "".join(f"{i}z{j}" for j in range(20))]) for i in range(100, 100 + rng.randint(0, 60)))
        pieces, at, covered = B.recursive_pieces(text, 40, overlap=12), 0, 0
        assert all(0 < len(p) <= 40 for p in pieces)
        for p in pieces:  # each begins at the end of the one before, or up to the overlap earlier
            at = max(i for i in range(max(0, covered - 12), covered + 1) if text.startswith(p, i))
            covered = max(covered, at + len(p))
        assert covered == len(text)


def test_semantic_spans():
    text = "# Head\n" + "x" * 50 + "\n- one\n- two\n" + "```\n" + "c" * 30 + "\n```" + "|a|b|\n" + "y" * 90
    spans = B.semantic_spans(text, 60)
    assert [text[a:b] for a, b in spans] == ["# Head\n" + "x" * 50 + "\n- ", "one\n- two\n```\n" + "c" * 30 + "\n```|a|b|", "\n" + "y" * 90]
