"""Structure-aware splits against plain re-statements of their rules."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import chunking as C, structure as S

ITEM, ROW = re.compile(r"[ \t]*(?:[*+-]|[0-9]+\.)[ \t]+"), re.compile(r"[ \t]*\|.*\|[ \t]*$")
DEFINITION = re.compile(r"(?m)^(?=[ \t]*(?:def|function|func|fn|public|private|protected|class|module|interface)[ \t]+)")
SENTENCE = re.compile(r"([.!?。！？；;][ \t\n\v\f\r]*)")


def sentences(text):
    parts = SENTENCE.split(text)
    joined = [a + b for a, b in zip(parts[::2], [*parts[1::2], ""])]
    return [x for x in joined if x.strip(" \t\n\v\f\r")]


def semantic_overlap(text, size):
    if len(text) <= size:
        return text
    out = ""
    for p in reversed(text.split("\n\n")):
        if len(p) + len(out) + 2 <= size:
            out = f"{p}\n\n{out}" if out else p
            continue
        room, inner = size - len(out), ""
        for s in reversed(sentences(p)) if room > 0 else ():
            if len(s) + len(inner) + 1 > room:
                break
            inner = f"{s} {inner}" if inner else s
        if inner:
            out = f"{inner}\n\n{out}" if out else inner
        break
    return text[-size:] if len(out) < size / 2 else out


def overlapping(text, size, back=3):
    pieces, out, start, total = [s.strip(" \t\n\v\f\r") for s in sentences(text)], [], 0, 0
    for i, s in enumerate(pieces):
        if total + len(s) > size and i > start:
            out.append(" ".join(pieces[start:i]))
            start = max(i - (back - 1), start + 1)
            total = sum(len(x) + 1 for x in pieces[start:i])
        total += len(s) + 1
    return out + [" ".join(pieces[start:])] * (len(pieces) > start)


def recursive(text, size, overlap):
    from test_chunking import sentence_chunks

    if len(text) <= size:
        return [text] if text else []
    out, now = [], ""
    for p in filter(None, (x.strip(" \t\n\v\f\r") for x in re.split(r"\n[\x20\x09-\x0D]*\n", text))):
        if len(p) > size:
            out += [now] * bool(now) + (overlapping(p, size) if len(p) > 2 * size else sentence_chunks(p, size))
            now = ""
        elif now and len(now) + len(p) + 2 > size:
            out.append(now)
            now = f"{semantic_overlap(now, overlap)}\n\n{p}" if len(now) > overlap else p
        else:
            now = f"{now}\n\n{p}" if now else p
    return out + [now] * bool(now)


def prose(rng):
    say = lambda: " ".join(rng.choices(["alpha", "be", "c", "delta"], k=rng.randint(1, 9))) + rng.choice([". ", "! ", "。", " "])
    return "".join(say() for _ in range(rng.randint(1, 6)))


def test_recursive_chunks_and_overlap(spark):
    rng = random.Random(1)
    texts = ["", "short", "x" * 300] + [rng.choice(["\n\n", "\n \n"]).join(prose(rng) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", C.recursive_chunks(F.col("text"), 120, 40).alias("c"), C.semantic_overlap(F.col("text"), 50).alias("o")).collect()
    for r in got:
        assert r.c == recursive(texts[r.i], 120, 40), texts[r.i]
        assert r.o == semantic_overlap(texts[r.i], 50) == S.overlap_of(texts[r.i], 50), texts[r.i]


def test_long_sections(spark):
    df = spark.createDataFrame([("One two. Three four! Five six? Seven",), ("short",), ("",)], "t string")
    got = [[(x.text, x.is_continuation) for x in r.c] for r in df.select(C.long_section(F.col("t"), 20).alias("c")).collect()]
    assert got == [[("One two. Three four!", False), ("Five six? Seven", True)], [("short", False)], []]


def blocks(text):
    lines = text.splitlines(keepends=True) if "\r" not in text else None
    fences, n, out, last = [x.strip(" \n").startswith("```") for x in lines], 0, [], ("text", None)
    total, solid = sum(fences), None
    for line, fence in zip(lines, fences):
        bare = line.rstrip("\n")
        n += fence
        if n % 2 == 1 and n < total:
            kind = ("code", n)
        elif fence and n % 2 == 0:
            kind = ("code", n - 1)
        elif ITEM.match(bare):
            kind = ("list", None)
        elif ROW.match(bare):
            kind = ("table", None)
        elif not bare.strip(" \t"):
            kind = None
        elif bare[0] in " \t":
            kind = ("list", None) if solid and solid[0] == "list" else ("text", None)
            solid = solid or None
        else:
            kind = ("text", None)
        if kind and not (bare[:1] in (" ", "\t") and not ITEM.match(bare) and not ROW.match(bare) and kind[0] != "code"):
            solid = kind
        kind = kind or last
        if out and last == kind:
            out[-1][1] += line
        else:
            out.append([kind[0], line])
        last = kind
    return [tuple(x) for x in out]


def pack(parts, size):
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(p) > size:
            out.append(now)
            now = ""
        now += p
    return out + [now] * bool(now)


def pieces(kind, text, size):
    if len(text) <= size:
        return [text]
    finer = lambda parts, f: [y for x in parts for y in (f(x) if len(x) > size else [x]) if y]
    lines, cut = lambda x: x.splitlines(keepends=True), lambda x: [x[i : i + size] for i in range(0, len(x), size)]
    if kind == "code":
        parts = finer(DEFINITION.split(text), lines)
    elif kind == "list":
        parts = finer(finer(re.split(r"(?m)^(?=[ \t]*(?:[*+-]|[0-9]+\.)[ \t]+)", text), lines), cut)
    elif kind == "table":
        parts = lines(text)
    else:
        ended = lambda x, p: re.sub(p, "\\1\x01", x).split("\x01")
        parts = finer(finer(ended(text, r"(\n[\x20\x09-\x0D]*\n)"), lambda x: ended(x, r"([.!?。！？；;][\x20\x09-\x0D]*|\n)")), cut)
    return pack([p for p in parts if p], size)


def mixed(rng):
    out = []
    for _ in range(rng.randint(1, 9)):
        kind = rng.randint(0, 5)
        if kind == 0:
            out.append("```py\n" + "\n".join(rng.choice(["def f(x):", "    return x", "class A:", "", "y = 1 " * 9]) for _ in range(rng.randint(0, 8))) + "\n```")
        elif kind == 1:
            out.append("\n".join(rng.choice(["- ", "* ", "2. "]) + prose(rng) + rng.choice(["", "\n  more of it", "\n\n"]) for _ in range(rng.randint(1, 6))))
        elif kind == 2:
            out.append("\n".join("| " + " | ".join(rng.choices("abc", k=rng.randint(1, 30))) + " |" for _ in range(rng.randint(1, 6))))
        elif kind == 3:
            out.append(rng.choice(["", "  indented", "```", "\t", "| half", "   "]))
        else:
            out.append("\n\n".join(prose(rng) for _ in range(rng.randint(1, 4))))
    return rng.choice(["\n", "\n\n"]).join(out)


def test_structure_split(spark):
    rng = random.Random(9)
    texts = ["", "\n", "plain", "```\nx", "- a\n- b"] + [mixed(rng) for _ in range(250)]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "id int, text string")
    got = {}
    for r in S.structure_split(df, "id", "text", 80, 30).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r)
    kinds = set()
    for i, text in enumerate(texts):
        own = got.get(i, [])
        assert "".join(r.text for r in own) == text and [r.piece for r in own] == list(range(len(own)))
        assert all(text[r.start : r.end] == r.text for r in own)
        want = [(k, p) for k, b in blocks(text) for p in pieces(k, b, 80)]
        assert [(r.kind, r.text) for r in own] == want, text
        for a, b in zip(own, own[1:]):
            if a.block == b.block and b.kind == "text":
                assert b.lead == semantic_overlap(a.text, 30)
            if a.block == b.block and b.kind == "code":
                assert b.lead.startswith("```")
            kinds.add((b.kind, a.block == b.block))
        assert all(len(r.text) <= 80 or r.kind in ("code", "table") and r.text.count("\n") <= 1 for r in own)
    assert len(kinds) == 8 and 9999 not in got


def test_markdown_chunks(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    md = f"# A\nsee [[b]] and [ref:c]\n## B\ntext of b, [x](#c)\n### C\n{long}\n\n- one\n- two\n# D\n\n# E\n[ref:nowhere] 「参见：C」"
    df = spark.createDataFrame([(1, md), (2, "no heading"), (3, None)], "id long, md string")
    rows = S.markdown_chunks(df, "id", "md", 1000, 100).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows)))
    context = "\n\n引用上下文: C (级别: 3)"
    assert rows[0].text == f"A\n\n[外部引用数: 2]\nsee [[b]] and [ref:c]{context}"
    assert rows[1].text == f"A > B\n\n[被引用次数: 1] [外部引用数: 1]\ntext of b, [x](#c){context}"
    own = [r for r in rows if r.heading_no == 3]
    assert len(own) == 3 and own[0].text.startswith("A > B > C\n\n[被引用次数: 3]\nSentence number 0") and own[2].kind == "list"
    assert own[1].text.startswith("A > B > C\n\n") and "[被" not in own[1].text
    assert rows[-1].text == f"E\n\n[外部引用数: 1]\n[ref:nowhere] 「参见：C」{context}"


def test_sections_and_references_agree(spark):
    """The function of one text against the DataFrame operators."""
    from docloom.functions import markdown as M

    rng = random.Random(12)
    titles = ["Intro", "Über <b>x</b>", "A-b c", "章节 二", "intro", "  Q "]
    line = lambda: rng.choice(["", "text", "```", "[[Intro]] [ref:a-b-c]", "see [x](#intro)", "「参见：章节 二」", "[[INTRO]]", f"{'#' * rng.randint(1, 4)} {rng.choice(titles)}", "  ", "[[none]]"])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    sections = {(r.id, r.heading_no): (r.breadcrumb, r.content) for r in M.sections(df, "id", "md").collect()}
    edges = S.reference_edges(df, "id", "md")
    contexts = {(r.id, r.heading_no): r.context for r in S.reference_contexts(edges, "id").collect()}
    counts, cites = {}, {}
    for r in edges.collect():
        counts[r.id, r.cited] = r.n_in
        cites[r.id, r.citing] = cites.get((r.id, r.citing), 0) + 1
    made = {(i, s["heading_no"]): s for i, t in enumerate(texts) for s in S.sections_of(t)}
    assert {k: (s["crumb"], s["content"]) for k, s in made.items()} == sections
    for k, s in made.items():
        assert (s["n_in"], s["n_out"], s["context"]) == (counts.get(k, 0), cites.get(k, 0), contexts.get(k, ""))
    assert len(contexts) > 20
