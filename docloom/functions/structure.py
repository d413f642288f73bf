"""Splits that keep structure: a text is tiled by code, list, table and text blocks, and each kind is split its own way.

Blocks are runs of lines.  A fenced block comes before all else, then list items with
their indented lines, then rows of a table; blank lines belong to the block before
them.  A block within the size is one piece.  A longer one is split between
definitions (then lines), items (then lines), rows, or paragraphs (then sentences, then
characters), and the parts are packed up to the size, so that the pieces of a text
join to it.  Spark has no find-all with positions, so the spans of a text come from a
small function of it, in Arrow batches; no row of a text leaves its partition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import markdown as M
from docloom.functions.chunking import MAX_CHUNK
from docloom.operators.boundaries import apply

#: How lines of lists and tables, and definitions in code, begin.
ITEM = re.compile(r"^[\x20\x09]*(?:[*+-]|[0-9]+\.)[\x20\x09]+", re.M)
ROW = re.compile(r"[\x20\x09]*\|[^\n]*\|[\x20\x09]*\n?$")
DEFINITION = re.compile(r"^[\x20\x09]*(?:def|function|func|fn|public|private|protected|class|module|interface)[\x20\x09]+", re.M)
HEADING = re.compile(r"(#{1,6})[\x20\x09]+(.+)$")
FENCE = re.compile(r" *```([0-9A-Za-z_]*)")
TARGETS = (re.compile(r"\[[^\]\n]+\]\(#([^)\n]+)\)"), re.compile(r"\[ref:([^\]\n]+)\]"), re.compile(r"\[\[([^\]\n]+)\]\]"), re.compile(r"「参见：([^」\n]+)」"))
BLANKS = " \t\n\v\f\r"
SENTENCE = re.compile(r".*?[.!?。！？；;][\x20\x09-\x0D]*|.+", re.S)
LINE, PARAGRAPH, ENDING = re.compile(r"\n"), re.compile(r"\n[\x20\x09-\x0D]*\n"), re.compile(r"[.!?。！？；;][\x20\x09-\x0D]*|\n")


def block_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind (code, list, table, text), start and end of the blocks that tile ``text``; the last fence of an odd number of them opens no block."""
    lines, start = [], 0
    while start < len(text):
        end = text.find("\n", start) + 1 or len(text)
        lines.append((start, end))
        start = end
    left = sum(text.startswith("```", a + _indent(text, a, b, " ")) for a, b in lines)
    out: list[list] = []
    kind, solid, is_open = "text", None, False
    for a, b in lines:
        new = False
        if text.startswith("```", a + _indent(text, a, b, " ")):
            left -= 1
            new = not is_open and left > 0
            is_open = is_open or new
            if new or is_open:
                kind = solid = "code"
            if is_open and not new:
                is_open = False
            elif not is_open:
                kind = solid = "text"
        elif not is_open:
            own = _kind(text, a, b)
            if own == "in":  # an indented line goes on with a list only
                kind = "list" if solid == "list" else "text"
            elif own:
                kind = solid = own
        if out and out[-1][0] == kind and not new:
            out[-1][2] = b
        else:
            out.append([kind, a, b])
    return [tuple(x) for x in out]


def _indent(text: str, a: int, b: int, blanks: str = " \t") -> int:
    n = a
    while n < b and text[n] in blanks:
        n += 1
    return n - a


def _kind(text: str, a: int, b: int) -> str | None:
    """The kind of a line outside fences by itself; ``in`` of other indented lines, None of blank ones."""
    if ITEM.match(text, a, b):
        return "list"
    if ROW.match(text, a, b):
        return "table"
    if not text[a:b].strip(" \t\n\v\f\r"):
        return None
    return "in" if text[a] in " \t" else "text"


def _at(pattern: re.Pattern, text: str, a: int, b: int, before: bool) -> list[tuple[int, int]]:
    """The span cut at the beginnings of matches, or at their ends."""
    own = text[a:b]
    edges = [a, *(a + (m.start() if before else m.end()) for m in pattern.finditer(own)), b]
    return [(x, y) for x, y in zip(edges, edges[1:]) if x < y]


def _finer(parts: list[tuple[int, int]], size: int, cut: Callable[[int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    return [y for a, b in parts for y in (cut(a, b) if b - a > size else [(a, b)])]


def _fitting(pieces: list[str], joiner: str, room: int) -> tuple[int, str]:
    """How many of the last pieces fit into ``room`` when joined, and these; one alone needs room for a joiner too."""
    total = 0
    for n, piece in enumerate(reversed(pieces)):
        total += len(piece) + (len(joiner) if n else 0)
        if total + (0 if n else len(joiner)) > room:
            return n, joiner.join(pieces[len(pieces) - n :])
    return len(pieces), joiner.join(pieces)


def overlap_of(text: str, size: int) -> str:
    """``chunking.semantic_overlap`` of one text."""
    if len(text) <= size:
        return text
    paragraphs = text.split("\n\n")
    while paragraphs and not paragraphs[-1]:
        paragraphs.pop()
    n, tail = _fitting(paragraphs, "\n\n", size)
    before = paragraphs[-n - 1] if n < len(paragraphs) else ""
    _, lead = _fitting([x for x in SENTENCE.findall(before) if x.strip(BLANKS)], " ", size - len(tail))
    out = "\n\n".join(x for x in (lead, tail) if x)
    return out if 2 * len(out) >= size else text[-size:]


def piece_spans(text: str, size: int = MAX_CHUNK) -> list[dict]:
    """kind, block, part, start, end of the pieces that tile ``text``; only a line of code or a row over ``size`` stays longer than that."""
    out = []
    lines = lambda a, b: _at(LINE, text, a, b, False)
    slices = lambda a, b: [(i, min(i + size, b)) for i in range(a, b, size)]
    for block, (kind, start, end) in enumerate(block_spans(text)):
        if end - start <= size:
            parts = [(start, end)]
        elif kind == "code":
            parts = _finer(_at(DEFINITION, text, start, end, True), size, lines)
        elif kind == "list":
            parts = _finer(_finer(_at(ITEM, text, start, end, True), size, lines), size, slices)
        elif kind == "table":
            parts = lines(start, end)
        else:
            parts = _finer(_finer(_at(PARAGRAPH, text, start, end, False), size, lambda a, b: _at(ENDING, text, a, b, False)), size, slices)
        at, now = start, start
        part = 0
        for a, b in [*parts, (end, end + size + 1)]:
            if b - at > size and now > at:
                out.append({"kind": kind, "block": block, "part": part, "start": at, "end": now})
                part, at = part + 1, now
            now = b
    return out


def led(text: str, pieces: list[dict], overlap: int) -> Iterator[tuple[dict, str]]:
    """Each piece, and what a reader needs before it where it continues a block."""
    head = before = ""
    for p in pieces:
        lead = ""
        if p["part"] == 0:
            head = text[p["start"] : text.find("\n", p["start"]) + 1]
        elif p["kind"] == "code":
            lead = head
        elif p["kind"] == "text" and overlap:
            lead = overlap_of(before, overlap)
        yield p, lead
        before = text[p["start"] : p["end"]]


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, kind, language (of code), start, end, start_line, n_lines of the blocks that tile ``text``."""

    def run(own: str) -> list[dict]:
        out, line = [], 0
        for kind, start, end in block_spans(own):
            n = own.count("\n", start, end) + (own[end - 1] != "\n")
            language = FENCE.match(own, start)[1] if kind == "code" else None
            out.append({"kind": kind, "language": language, "start": start, "end": end, "start_line": line, "n_lines": n})
            line += n
        return out

    found = apply(docs.filter(F.length(text) > 0), key, [text], run, "array<struct<kind:string,language:string,start:bigint,end:bigint,start_line:bigint,n_lines:bigint>>")
    return found.select(key, F.posexplode("value").alias("block", "b")).select(key, F.col("block").cast("long").alias("block"), "b.*")


def structure_split(docs: DataFrame, key: str, text: str, size: int = MAX_CHUNK, overlap: int = 0) -> DataFrame:
    """key, piece (from 0), kind, block, start, end, text, lead: pieces that tile ``text``.

    ``lead`` is what a reader needs before a piece that continues a block: the fence line of
    split code, and the semantic overlap of plain text, where ``overlap`` asks for one.
    """

    def run(own: str) -> list[dict]:
        return [{**p, "text": own[p["start"] : p["end"]], "head": lead} for p, lead in led(own, piece_spans(own, size), overlap)]

    found = apply(docs.filter(F.length(text) > 0), key, [text], run, "array<struct<kind:string,block:bigint,part:int,start:bigint,end:bigint,text:string,head:string>>")
    each = found.select(key, F.posexplode("value").alias("piece", "p"))
    return each.select(key, F.col("piece").cast("long").alias("piece"), "p.kind", "p.block", "p.start", "p.end", "p.text", F.col("p.head").alias("lead"))


def reference_edges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, citing, cited (numbers of headings), title, level, heading_id, n_in: sections that name a heading, and how often their text names it is named in all.

    A reference outside all sections has no citing section.
    """
    found = M.headings(docs, key, text)
    rows = M.lines(docs, key, text).filter("not in_code").select(key, F.col("heading_no").alias("citing"), F.explode(M.reference_targets(F.col("line"))).alias("target"))
    names = found.select(key, "heading_no", F.explode(F.array_distinct(F.array("heading_id", "title", F.lower("title")))).alias("name"))
    last = names.groupBy(key, "name").agg(F.max("heading_no").alias("named"))
    exact = rows.join(last.withColumnRenamed("name", "target"), [key, "target"], "left").withColumnRenamed("named", "by_name")
    lowered = exact.withColumn("low", F.lower("target")).join(last.select(key, F.col("name").alias("low"), F.col("named").alias("by_low")), [key, "low"], "left")
    edges = lowered.select(key, "citing", F.coalesce("by_name", "by_low").alias("cited")).filter("cited is not null")
    counts = edges.groupBy(key, "cited").agg(F.count("*").alias("n_in"))
    return edges.join(counts, [key, "cited"]).join(found.select(key, F.col("heading_no").alias("cited"), "title", "level", "heading_id"), [key, "cited"])


def reference_contexts(edges: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, heading_no, context: for each citing section, a line for every heading it names that is named ``least`` times or more, in the order of headings."""
    named = edges.filter((F.col("n_in") >= least) & (F.col("citing") > 0)).select(key, F.col("citing").alias("heading_no"), "cited", "title", "level").distinct()
    line = lambda x: F.concat(F.lit("\n\n引用上下文: "), x["title"], F.lit(" (级别: "), x["level"].cast("string"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("cited", "title", "level")))
    return named.groupBy(key, "heading_no").agg(F.array_join(F.transform(listed, line), "").alias("context"))


def sections_of(text: str) -> list[dict]:
    """The sections of a markdown text, as ``markdown.sections`` and ``reference_edges`` tell them, with what a chunk says of its references.

    ``under``: the section or one that encloses it is named somewhere; ``context``: a line for each heading that it names and that is named twice or more.
    """
    found: list[dict] = []
    stack: list[dict] = []
    refs: list[tuple[int, str]] = []
    is_open = False
    for line in text.split("\n"):
        fence = line.strip(" ").startswith("```")
        in_code, is_open = fence or is_open, is_open != fence
        if in_code:
            continue
        if m := HEADING.match(line):
            title = m[2].strip(BLANKS)
            while stack and stack[-1]["level"] >= len(m[1]):
                stack.pop()
            stack.append({"no": len(found) + 1, "level": len(m[1]), "title": title, "id": slug(title), "lines": [], "above": [x["no"] for x in stack] + [len(found) + 1]})
            stack[-1]["crumb"] = " > ".join(x["title"] for x in stack)
            found.append(stack[-1])
        elif found:
            found[-1]["lines"].append(line)
        refs += [(len(found), t) for p in TARGETS for t in p.findall(line)]
    names = {name: h["no"] for h in found for name in (h["id"], h["title"], h["title"].lower())}  # of headings with one name the last
    edges = [(a, b) for a, t in refs if (b := names.get(t) or names.get(t.lower()))]
    n_in, n_out = Counter(b for _, b in edges), Counter(a for a, _ in edges)
    named: dict[int, set[int]] = {}
    for a, b in edges:
        named.setdefault(a, set()).add(b)
    out = []
    for h in found:
        lines = [f"\n\n引用上下文: {found[b - 1]['title']} (级别: {found[b - 1]['level']})" for b in sorted(named.get(h["no"], ())) if n_in[b] > 1]
        under = any(n_in[x] for x in h["above"])
        out.append({"heading_no": h["no"], "crumb": h["crumb"], "content": "\n".join(h["lines"]).strip(BLANKS), "under": under, "n_in": n_in[h["no"]], "n_out": n_out[h["no"]], "context": "".join(lines)})
    return out


def slug(title: str) -> str:
    return re.sub("[^a-z0-9一-龥]+", "-", re.sub("<[^>]*>", "", title).lower()).strip("-")


def markdown_chunks(docs: DataFrame, key: str, text: str, size: int = MAX_CHUNK, overlap: int = 100) -> DataFrame:
    """key, chunk_index, heading_no, kind, text: the sections of a markdown text as chunks that can be read by themselves.

    A chunk has the titles above it, on a section's first chunk the counts of references, where
    the section or one above it is named or it names others itself, then its content, and lines
    on the headings it names that others name too.  Content over ``size`` is split by structure.
    """

    def run(own: str) -> list[dict]:
        made = []
        for s in sections_of(own):
            if not s["content"]:
                continue
            marks = [f"[被引用次数: {s['n_in']}]"] * s["under"] + [f"[外部引用数: {s['n_out']}]"] * (s["n_out"] > 0)
            head, meta = f"{s['crumb']}\n\n", " ".join(marks) + "\n" if marks else ""
            if len(head) + len(meta) + len(s["content"]) <= size:
                made.append({"heading_no": s["heading_no"], "kind": "section", "text": head + meta + s["content"] + s["context"]})
                continue
            for p, lead in led(s["content"], piece_spans(s["content"], size), overlap):
                first, gap = meta if p["start"] == 0 else "", "\n\n" if lead and p["kind"] == "text" else ""
                made.append({"heading_no": s["heading_no"], "kind": p["kind"], "text": head + first + lead + gap + s["content"][p["start"] : p["end"]] + s["context"]})
        return made

    found = apply(docs.filter(F.length(text) > 0), key, [text], run, "array<struct<heading_no:bigint,kind:string,text:string>>")
    return found.select(key, F.posexplode("value").alias("i", "p")).select(key, F.col("i").cast("long").alias("chunk_index"), "p.heading_no", "p.kind", "p.text")
