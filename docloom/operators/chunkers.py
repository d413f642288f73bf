"""Chunkers by name and by file type: rows (key, text) to one row a chunk (key, chunk_index, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import chunking as C, markdown as M, structure as S, text as T
from docloom.operators import boundaries as B

Chunker = Callable[[DataFrame, str, str], DataFrame]


def _pieces(f: Callable, *columns: str) -> Chunker:
    def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
        found = B.apply(docs.select(key, text), key, [text], f, "array<string>")
        return found.select(key, F.posexplode("value").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))

    return chunks


def _column(f: Callable) -> Chunker:
    return lambda docs, key, text: C.exploded(docs, key, f(F.col(text)))


def _spans(x: str) -> list[str]:
    return [x[a:b] for a, b in B.enhanced_spans(x)]


CHUNKERS: dict[str, Chunker] = {
    "paragraph": _column(C.paragraph_chunks),
    "line": _column(lambda c: C.paragraph_chunks(c, separator="\n")),
    "sentence": _column(C.sentence_chunks),
    "fixed": _column(lambda c: C.windows(c, C.MAX_CHUNK)),
    "heading": _column(lambda c: C.heading_chunks(c, "#")),
    "html": _column(lambda c: F.transform(F.split(F.regexp_replace(c, r"(?i)(<h[1-6][^>]*>)", "\x01$1"), "\x01"), T.html_to_text)),
    "markdown": M.section_chunks,
    "markdown_full": lambda docs, key, text: S.markdown_chunks(docs, key, text).select(key, "chunk_index", "text"),
    "structure": lambda docs, key, text: S.structure_split(docs, key, text).select(key, F.col("piece").alias("chunk_index"), "text"),
    "recursive": _column(C.recursive_chunks),
    "code": _pieces(B.code_pieces),
    "list": _pieces(B.list_pieces),
    "semantic": _pieces(B.semantic_sections),
    "recursive_markdown": _pieces(B.recursive_pieces),
    "enhanced": _pieces(_spans),
}


def chunker(name: str) -> Chunker:
    """The chunker of that name; the sentence splitter for names that aren't known."""
    return CHUNKERS.get(name, CHUNKERS["sentence"])


def by_type(docs: DataFrame, key: str, text: str, file_type: str = "file_type", other: str = "paragraph") -> DataFrame:
    """key, chunk_index, text, chunk_count: markdown files by sections, all others by ``other``; empty texts have no chunks."""
    rows = docs.filter(F.col(text) != "")
    md = F.lower(file_type).isin("md", "markdown")
    parts = CHUNKERS["markdown"](rows.filter(md), key, text).unionByName(CHUNKERS[other](rows.filter(~md | md.isNull()), key, text))
    return parts.join(parts.groupBy(key).agg(F.count("*").alias("chunk_count")), key)
