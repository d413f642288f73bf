"""Queries of document formats and of chunkers that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import dispatch as D
from docloom.operators import table_functions
from docloom.plans.chunk_queries import _PARAGRAPHS
from docloom.plans.registry import query
from docloom.sources import office
from docloom.tables import Tables, dealt

_CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query(f"""SELECT doc_id, CAST(len(ls) AS BIGINT) AS paragraph_count, CAST(1 AS BIGINT) AS heading_count, md5(array_to_string(list_concat(['# ' || ls[1]], list_filter(ls[2:], lambda x: x <> '')), chr(10) || chr(10))) AS markdown_md5,
    CAST(len(ls) // 40 AS BIGINT) AS pages, CAST(length(array_to_string(ls, chr(10))) // 4 AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS heading_levels, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS ls FROM documents)""")
def scan_docx(t: Tables) -> DataFrame:
    """Documents as docx files, the first line as a heading, read again: counts, features and markdown."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i == 0, 1).alias("level"), x.alias("text")))
    texts = dealt(t.documents.select("doc_id", "text"), "doc_id")
    files = office.docx_files(texts.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), lines.alias("blocks")), "path", "blocks")
    found, blocks = office.blocks_of(files), F.col("blocks")
    headings = F.size(office.of_kind(blocks, "heading")).cast("long")
    features = D.word_features(office.paragraphs(blocks), F.size(office.of_kind(blocks, "table")), F.col("n_images"), headings)
    return found.select(
        F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"),
        F.size(office.of_kind(blocks, "paragraph", "heading")).cast("long").alias("paragraph_count"),
        headings.alias("heading_count"),
        F.md5(office.markdown_of(blocks)).alias("markdown_md5"),
        *(features[c].cast("long").alias(c) for c in ("pages", "tokens", "heading_levels")),
        "error",
    )


@query(_PARAGRAPHS)
def sql_chunker(t: Tables) -> DataFrame:
    """A chunker that SQL calls for each document."""
    table_functions.register(t.spark, "docloom_chunk")
    return t.spark.sql("SELECT d.doc_id, c.* FROM {documents} d, LATERAL docloom_chunk(d.text, 'line') c", documents=t.documents.select("doc_id", "text"))
