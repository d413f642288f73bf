"""Chunkers that need the places of matches: a small function of one text, applied to Arrow batches.

Spark has no find-all with positions, so these four take a text to a list of
spans or pieces inside ``mapInArrow``; Spark deals out the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks a boundary, and its importance; a heading loses a tenth with each level.
KINDS = (
    ("heading", re.compile(r"^(#{1,6})\s+(.+)$", re.M), 1.0),
    ("heading", re.compile(r"<h([1-6])>(.*?)</h\1>", re.S), 1.0),
    ("list", re.compile(r"^(\s*[-*+]|\s*\d+\.)\s+(.+)$", re.M), 0.6),
    ("code", re.compile(r"```[\s\S]*?```"), 0.9),
    ("table", re.compile(r"(\|[^\n]+\|\n)((?:\|[-:]+)+\|)(\n(?:\|[^\n]+\|\n?)+)"), 0.9),
    ("quote", re.compile(r"^>\s+(.+)$", re.M), 0.7),
    ("rule", re.compile(r"^(---|\*\*\*|___)\s*$", re.M), 0.8),
    ("section", re.compile(r"\n{3,}"), 0.9),
    ("paragraph", re.compile(r"\n\n+"), 0.8),
    ("sentence", re.compile(r"[。！？；.!?;]\s*"), 0.5),
)
HTML_PARAGRAPH = ("paragraph", re.compile(r"<p>(.*?)</p>", re.S), 0.8)
#: What ends a part of the semantic split.
SPLITS = (
    r"(?m)^#{1,6}[\x20\x09-\x0D]+.+$",
    r"(?m)^.+\n[=\-]{2,}$",
    r"(?s)<h[1-6]>.*?</h[1-6]>",
    r"(?m)^[\x20\x09-\x0D]*[-*+][\x20\x09-\x0D]+",
    r"(?m)^[\x20\x09-\x0D]*[0-9]+\.[\x20\x09-\x0D]+",
    r"(?s)```.*?```",
    r"\|.+\|.+\|",
)
#: Rows whose texts are taken apart together.
AT_ONCE = 64
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
#: Separators of the recursive splitter, the coarsest first.
SEPARATORS = ("\n\n---\n\n", "\n\n***\n\n", "\n\n___\n\n", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n\n", "\n", " ", "")
DEFINITION = re.compile(r"^(?=[\x20\x09]*(?:def|function|func|fn|public|private|protected|class|module|interface)[\x20\x09]+)", re.M)


def _spans(kind: str, m: re.Match) -> list[tuple[int, int]]:
    """Where the boundaries of a match lie: what opens and closes fences, tables and HTML paragraphs, the marks of items and quotes, else the match."""
    start, end, lines = m.start(), m.end(), m[0].split("\n")
    if kind == "list":
        return [(start, start + len(m[1]))]
    if kind == "quote":
        return [(start, start + 2)]
    if kind == "code":
        return [(start, min(end, start + len(lines[0]) + 1))] + [(end - len(lines[-1]), end)] * (len(lines) > 1)
    if kind == "table":
        return [(start, start + len(lines[0]) + len(lines[1]) + 2), (end - len(lines[-1]), end)]
    if kind == "paragraph" and m[0].startswith("<p>"):
        return [(start, start + 3), (end - 4, end)]
    return [(start, end)]


def boundaries(text: str, html: bool = False) -> list[dict]:
    """type, start, end, level, title, importance of the boundaries by their start; with ``html``, paragraphs in tags too."""
    out = []
    for kind, pattern, weight in [*KINDS[:7], *[HTML_PARAGRAPH] * html, *KINDS[7:]]:
        for m in pattern.finditer(text):
            level = (len(m[1]) if m[1][0] == "#" else int(m[1])) if kind == "heading" else None
            for start, end in _spans(kind, m):
                out.append({"type": kind, "start": start, "end": end, "level": level, "title": m[2].strip() if level else None, "importance": round(weight * (1 - 0.1 * ((level or 1) - 1)), 2)})
    return sorted(out, key=lambda b: b["start"])


def enhanced_chunks(text: str, size: int = 1024, least: int = 100, most: int = 2048, html: bool = False) -> list[dict]:
    """start, end, heading, level, types of spans that end at boundaries and tile the text.

    A chunk ends before a boundary that would take it over ``most``; after an
    important one (0.8) that comes ``least`` characters or more after its start; and
    else at ``size``, unless the first better boundary (0.7) of the next nine comes
    within ``most``.  ``heading`` is the last one up to the chunk's end, ``types`` are
    those of the boundaries that the chunk has passed.
    """
    found, start, out = boundaries(text, html), 0, []
    heading, level, types = None, None, []

    def close(end: int) -> None:
        nonlocal start, types
        if end > start:
            out.append({"start": start, "end": end, "heading": heading, "level": level, "types": types})
            start, types = end, []

    for i, b in enumerate(found):
        n = b["start"] - start
        if n > most and n > least:
            close(b["start"])
            n = 0
        if b["level"]:
            heading, level = b["title"], b["level"]
        types.append(b["type"])
        if b["importance"] >= 0.8 and n >= least:
            close(b["end"])
        elif n >= size:
            better = next((x for x in found[i + 1 : i + 10] if x["importance"] >= 0.7), None)
            if not (better and better["start"] - start <= most):
                close(b["end"])
    close(len(text))
    return out


def enhanced_spans(text: str, size: int = 1024, least: int = 100, most: int = 2048) -> list[tuple[int, int]]:
    return [(c["start"], c["end"]) for c in enhanced_chunks(text, size, least, most)]


def semantic_spans(text: str, size: int = 1000) -> list[tuple[int, int]]:
    """Spans that tile the text and end after headings, marks of items, fences and rows of tables where that keeps them within ``size``."""
    return spans_at(sorted({m.end() for p in SPLITS for m in re.finditer(p, text)}), text, size)


def spans_by(pattern: re.Pattern, text: str, size: int) -> list[tuple[int, int]]:
    """Spans that tile the text and end at matches where that keeps them within ``size``; a longer stretch without a match stays whole."""
    return spans_at([m.end() for m in pattern.finditer(text)], text, size)


def spans_at(ends: list[int], text: str, size: int) -> list[tuple[int, int]]:
    start, last, out = 0, 0, []
    for end in [*ends, len(text)]:
        if end - start > size and last > start:
            out.append((start, last))
            start = last
        last = end
    return out + [(start, len(text))] if start < len(text) else out


def recursive_pieces(text: str, size: int = 1024, separators: tuple[str, ...] = SEPARATORS, overlap: int = 0) -> list[str]:
    """Pieces of up to ``size``, cut at the coarsest separator that does; a piece begins with up to ``overlap`` characters of whole parts of the one before.

    Without an overlap they join to the text.
    """
    if len(text) <= size:
        return [text] if text else []
    head, *rest = separators
    parts = text.split(head) if head else [text[i : i + max(1, overlap // 4 or size)] for i in range(0, len(text), max(1, overlap // 4 or size))]
    parts = [p if i == 0 else head + p for i, p in enumerate(parts)]
    out: list[str] = []
    now: list[str] = []
    total = 0
    for p in parts:
        if len(p) > size:
            out += ["".join(now)] * bool(now) + recursive_pieces(p, size, tuple(rest), overlap)
            now, total = [], 0
            continue
        if total + len(p) > size:
            out.append("".join(now))
            while now and (total > overlap or total + len(p) > size):
                total -= len(now.pop(0))
        now.append(p)
        total += len(p)
    return [x for x in [*out, "".join(now)] if x]


def packed_lines(pieces: list[str], size: int) -> list[str]:
    out, now = [], ""
    for p in pieces:
        if now and len(now) + len(p) > size:
            out.append(now)
            now = ""
        now += p
    return out + [now] * bool(now)


def sentence_pieces(paragraph: str, size: int) -> list[str]:
    """Sentences packed with spaces, as ``chunking.sentence_chunks`` does."""
    out, now, n = [], "", 0
    for x in paragraph.replace(". ", ".\n").split("\n"):
        if len(x) > size:
            out += [now] * bool(now) + [x[i : i + size] for i in range(0, len(x), size)]
            now, n = "", 0
        elif n + len(x) > size:
            out += [now] * bool(now)
            now, n = x, len(x)
        else:
            now, n = f"{now} {x}" if now else x, n + len(x) + 1
    return out + [now] * bool(now)


def paragraph_pieces(text: str, separator: str = "\n\n", size: int = 1000) -> list[str]:
    """Paragraphs packed up to ``size``, as ``chunking.paragraph_chunks`` does."""
    out, now, n = [], "", 0
    for x in text.split(separator):
        if len(x) > size:
            out += [now] * bool(now) + sentence_pieces(x, size)
            now, n = "", 0
        elif n + len(x) > size:
            out += [now] * bool(now)
            now, n = x, len(x)
        else:
            now, n = f"{now}{separator}{x}" if now else x, n + len(x)
    return out + [now] * bool(now)


def code_pieces(block: str, size: int = 1000) -> list[str]:
    """A fenced block in pieces that are fenced again: whole definitions where they fit, else lines."""
    m = re.fullmatch(r"```(\w*)\n(.*?)\n?```", block.strip(), re.S)
    if len(block) <= size or not m:
        return [block]
    room = size - 8 - len(m[1])
    parts: list[str] = []
    for part in re.split(DEFINITION, m[2]):
        parts += [part] if len(part) <= room else packed_lines(re.findall(r"[^\n]*\n|[^\n]+", part), room)
    return [f"```{m[1]}\n{p.rstrip(chr(10))}\n```" for p in packed_lines(parts, room) if p.strip()]


def list_pieces(text: str, size: int = 1000) -> list[str]:
    """List items packed up to ``size``."""
    return packed_lines([p for p in re.split(r"(?m)^(?=\s*(?:[-*+]|\d+\.)\s)", text) if p], size)


def semantic_sections(text: str, size: int = 1024) -> list[str]:
    """Sections cut before headings (also numbered lines) and at ``size``, then merged up to ``size``; fenced code stays whole."""
    code: list[str] = []
    masked = re.sub(r"```.*?```", lambda m: code.append(m[0]) or f"\x00{len(code) - 1}\x00", text, flags=re.S)
    parts, now = [], ""
    for line in masked.split("\n"):
        heading = re.match(r"(#{1,6}|\*\*|__|\d+\.)\s+.+$", line)
        if now and (heading or len(now) >= size):
            parts.append(now.strip("\n"))
            now = ""
        now += line + "\n"
    parts.append(now.strip("\n"))
    out, acc, n = [], [], 0
    for p in filter(None, parts):
        if acc and n + len(p) > size:
            out.append("\n\n".join(acc))
            acc, n = [], 0
        acc.append(p)
        n += len(p) + 2
    out += ["\n\n".join(acc)] * bool(acc)
    return [re.sub("\x00(\\d+)\x00", lambda m: code[int(m[1])], x) for x in out]


def generic_sections(text: str, size: int = 1024) -> list[dict]:
    """Paragraphs packed under headings: a short line of its own that ends with a colon, or is in upper or title case."""
    out: list[dict] = []
    heading, acc, n = None, [], 0

    def close() -> None:
        nonlocal acc, n
        if acc:
            out.append({"heading": heading, "text": "\n\n".join(acc)})
        acc, n = [], 0

    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n|\n", text))):
        if len(p) < 100 and (p.endswith(":") or p.isupper() or p.istitle()):
            close()
            heading = p
            continue
        if acc and n + len(p) > size:
            close()
        acc.append(p)
        n += len(p) + 2
    close()
    return out


def diff_sections(old: str, new: str, least: int = 5) -> list[str]:
    """Sections of the new text around added lines, each with the unchanged lines that follow up to ``least`` lines."""
    import difflib

    out, now, is_open = [], [], False
    for line in difflib.ndiff(old.split("\n"), new.split("\n")):
        mark, body = line[:2], line[2:]
        if mark in ("+ ", "- "):
            is_open = True
            now += [body] if mark == "+ " else []
        elif mark == "  " and is_open:
            if len(now) >= least:
                out.append("\n".join(now))
                now, is_open = [], False
            else:
                now.append(body)
    return out + ["\n".join(now)] * bool(now)


def apply(rows: DataFrame, key: str, columns: list[str], f: Callable, kind: str) -> DataFrame:
    """key, value: ``f`` of the columns of each row (null: empty), of the Spark type ``kind``."""
    return _applied(rows, key, columns, f, None, kind).drop("error")


def apply_or(rows: DataFrame, key: str, columns: list[str], f: Callable, instead: Callable, kind: str) -> DataFrame:
    """key, value, error: like ``apply``; a row for which ``f`` fails gets ``instead`` and the failure as error, and the job goes on."""
    return _applied(rows, key, columns, f, instead, kind)


def _applied(rows: DataFrame, key: str, columns: list[str], f: Callable, instead: Callable | None, kind: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    value = to_arrow_type(_parse_datatype_string(kind))

    def one(own: list) -> tuple:
        if instead is None:
            return f(*own), None
        try:
            return f(*own), None
        except Exception as e:  # whatever the caller's function raises is this row's failure
            return instead(*own), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                made = [one([x or "" for x in own]) for own in zip(*(batch.column(c).to_pylist() for c in columns))]
                yield pa.record_batch([batch.column(key), pa.array([m[0] for m in made], value), pa.array([m[1] for m in made], pa.string())], [key, "value", "error"])

    return rows.select(key, *columns).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, value {kind}, error string")


def enhanced(docs: DataFrame, key: str, text: str, overlap: int = 0, **sizes: int) -> DataFrame:
    """key, chunk_index, start, end, heading, level, types, text: ``enhanced_chunks`` of each text, a chunk with the first ``overlap`` characters of the next one."""

    def run(own: str) -> list[dict]:
        return [{**c, "text": own[c["start"] : c["end"]]} for c in enhanced_chunks(own, **sizes)]

    found = apply(docs, key, [text], run, "array<struct<start:bigint,end:bigint,heading:string,level:int,types:array<string>,text:string>>")
    following = F.coalesce(F.left(F.get("value", F.col("i") + 1)["text"], F.lit(overlap)), F.lit(""))
    each = found.select(key, "value", F.posexplode("value").alias("i", "c"))
    return each.select(key, F.col("i").cast("long").alias("chunk_index"), "c.start", "c.end", "c.heading", "c.level", "c.types", F.concat("c.text", following).alias("text"))
