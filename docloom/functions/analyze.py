"""Features, complexity and chunking parameters of a document, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import html_to_text

#: Default chunk size and overlap.
CHUNK_SIZE, CHUNK_OVERLAP = 1024, 20


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def markdown_features(text: Column) -> dict[str, Column]:
    levels = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})[\x20\x09]+[^\n]+$"), 1)
    return {
        "heading_levels": F.size(F.array_distinct(levels)).cast("long"),
        "has_code": text.rlike(r"(?s)```.*?```"),
        "has_tables": F.contains(text, F.lit("|---")) | F.contains(text, F.lit("| ---")),
        "has_images": F.contains(text, F.lit("![")),
        "pages": _div(_count(text, "\n"), 40) + 1,
        "tokens": _div(F.length(text), 4),
    }


def text_features(text: Column) -> dict[str, Column]:
    lines, pieces = F.split(text, "\n"), F.split(text, "[.!?]+")
    tabular = F.filter(lines, lambda x: (_count(x, "\t") > 2) | (_count(x, r"\|") > 2))
    return {
        "pages": _div(_count(text, "\n"), 40) + 1,
        "tokens": _div(F.length(text), 4),
        "has_tables": (F.size(lines) > 3) & (F.size(tabular) > 3),
        "mean_sentence": F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size(pieces),
    }


def html_features(html: Column) -> dict[str, Column]:
    tag = lambda names: html.rlike(rf"(?i)<({names})[\s>/]")
    plain = F.length(html_to_text(html))
    levels = F.transform(F.regexp_extract_all(html, F.lit("(?i)<h([1-6])[\\s>]"), 1), lambda x: x)
    return {
        "has_tables": tag("table"),
        "has_images": tag("img"),
        "has_code": tag("code|pre"),
        "tokens": _div(plain, 4),
        "pages": _div(plain, 3000) + 1,
        "heading_levels": F.size(F.array_distinct(levels)).cast("long"),
    }


def code_features(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    comments = F.filter(lines, lambda x: F.trim(x).rlike(r"^(#|//|/\*|\*)"))
    return {"pages": _div(_count(text, "\n"), 50) + 1, "tokens": _div(F.length(text), 3), "comment_ratio": F.size(comments) / F.size(lines)}


def table_features(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    return {
        "n_rows": F.size(lines).cast("long"),
        "pages": F.greatest(F.lit(1).cast("long"), _div(F.size(lines), 100)),
        "tokens": _div(F.length(text), 5),
        "n_columns": (_count(lines[0], ",") + 1).cast("long"),
    }


def language(text: Column, sample: int = 100) -> Column:
    """zh where over a fifth of the sample's characters are Chinese, unknown where it is empty, else en."""
    head = F.substring(text, 1, sample)
    return F.when(F.length(head) == 0, "unknown").when(_count(head, r"[\x{4e00}-\x{9fff}]") > F.length(head) * 0.2, "zh").otherwise("en")


def complexity(pages: Column, n_tokens: Column, tables: Column, images: Column, code: Column) -> Column:
    return (
        F.when((pages > 50) | (n_tokens > 50000) | ((tables | images) & (pages > 20)), "high")
        .when((pages > 10) | (n_tokens > 10000) | tables | images | code, "medium")
        .otherwise("low")
    )


def chunk_parameters(kind: str, level: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, **features: Column) -> tuple[Column, Column]:
    """Chunk size and overlap for one kind of document."""
    whole = lambda x: F.lit(int(x))
    base, over = whole(size), whole(overlap)
    wide = whole(min(2048, size * 1.2))
    if kind == "markdown":
        base = F.when(features["heading_levels"] > 3, whole(min(2048, size * 1.5))).otherwise(base)
        half = F.greatest(F.lit(512), F.floor(base / 2)).cast("int")
        more = F.least(F.lit(2048), F.floor(base * 1.5)).cast("int")
        return F.when(level == "high", half).when(level == "low", more).otherwise(base), F.when(level == "high", whole(min(150, overlap * 2))).otherwise(over)
    if kind in ("code", "table"):
        return whole(min(1024, size)), whole(min(100, overlap) if kind == "code" else 0)
    if kind == "pdf":
        rich = features["has_images"] | features["has_tables"]
        base = F.when(rich, whole(max(512, size // 2))).otherwise(base)
        small = F.greatest(F.lit(256), F.floor(base / 2)).cast("int")
        more = F.least(F.lit(2048), F.floor(base * 1.2)).cast("int")
        return F.when(level == "high", small).when(level == "low", more).otherwise(base), F.when(rich, whole(min(200, overlap * 1.5))).otherwise(over)
    sized = F.when(level == "high", whole(max(512, size // 1.5))).when(level == "low", wide).otherwise(base)
    longer = features["mean_sentence"] > 100 if kind == "text" else level == "high"
    return sized, F.when(longer, whole(min(200, overlap * 1.5))).otherwise(over)
