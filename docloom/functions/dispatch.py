"""What is done to a document by its type: features, complexity, chunk size and overlap, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import analyze

#: Endings of each kind of file.
KINDS = {
    "pdf": ("pdf",),
    "word": ("docx", "doc"),
    "markdown": ("md", "markdown"),
    "html": ("html", "htm"),
    "code": ("py", "js", "java", "cpp", "c", "rb"),
    "table": ("csv", "xlsx", "xls"),
    "text": ("txt",),
    "slides": ("ppt", "pptx"),
}
FIELDS = {"pages": "long", "tokens": "long", "has_tables": "boolean", "has_images": "boolean", "has_code": "boolean", "heading_levels": "long", "mean_sentence": "double"}


def kind_of(file_type: Column) -> Column:
    """Kind of a file by its ending; ``generic`` where that isn't known."""
    low, out = F.lower(file_type), F.lit("generic")
    for kind, endings in KINDS.items():
        out = F.when(low.isin(*endings), F.lit(kind)).otherwise(out)
    return out


def pdf_features(page_count: Column, pages: Column, images: Column, toc: Column) -> dict[str, Column]:
    """Of extracted pages (texts), of which the first ten count: ``images`` is their number of images, ``toc`` the levels of the contents' entries."""
    head = F.slice(pages, 1, 10)
    chars = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return {
        "pages": page_count,
        "tokens": F.floor(chars / 4),
        "has_tables": F.exists(head, lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t"))),
        "has_images": images > 0,
        "heading_levels": F.size(F.array_distinct(toc)).cast("long"),
        "text_density": F.when(F.size(head) > 0, chars / F.size(head)).otherwise(F.lit(0.0)),
    }


def word_features(paragraphs: Column, tables: Column, images: Column, n_headings: Column) -> dict[str, Column]:
    """Of extracted paragraphs (texts), and numbers of tables, images and heading paragraphs."""
    chars = F.length(F.array_join(paragraphs, "\n"))
    level = F.when(n_headings > 10, 3).when(n_headings > 3, 2).otherwise(1)
    return {"pages": F.floor(F.size(paragraphs) / 40), "tokens": F.floor(chars / 4), "has_tables": tables > 0, "has_images": images > 0, "heading_levels": level.cast("long")}


def slide_features(slides: Column, shapes: Column, tables: Column, images: Column) -> dict[str, Column]:
    """Of the number of slides, extracted shapes (texts), and numbers of tables and images."""
    chars = F.aggregate(shapes, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return {"pages": slides, "tokens": F.floor(chars / 4), "has_tables": tables > 0, "has_images": images > 0}


def generic_features(size: Column) -> dict[str, Column]:
    return {"pages": F.lit(1).cast("long"), "tokens": F.floor(size / 10)}


def _filled(known: dict[str, Column]) -> Column:
    return F.struct(*(known.get(n, F.lit(None if t == "double" else 0 if t == "long" else False)).cast(t).alias(n) for n, t in FIELDS.items()))


def features(kind: Column, text: Column) -> Column:
    """A struct of ``FIELDS`` by kind; kinds whose text must be extracted first are taken as generic text."""
    out = _filled(generic_features(F.octet_length(text)))
    made = {"markdown": analyze.markdown_features, "html": analyze.html_features, "code": analyze.code_features, "table": analyze.table_features, "text": analyze.text_features}
    for name, f in made.items():
        out = F.when(kind == name, _filled(f(text))).otherwise(out)
    return out


def complexity(f: Column) -> Column:
    return analyze.complexity(f["pages"], f["tokens"], f["has_tables"], f["has_images"], f["has_code"])


def chunk_parameters(kind: Column, level: Column, f: Column) -> Column:
    """struct(chunk_size, chunk_overlap)."""
    made = lambda name: F.struct(*(c.alias(n) for n, c in zip(("chunk_size", "chunk_overlap"), analyze.chunk_parameters(name, level, **{n: f[n] for n in FIELDS if n not in ("pages", "tokens")}))))
    out = made("generic")
    for name in ("markdown", "code", "table", "pdf", "text"):
        out = F.when(kind == name, made(name)).otherwise(out)
    return out
