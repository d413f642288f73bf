"""Readers and writers of documents, and a registry of named sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.boundaries import apply_or

Reader = Callable[..., DataFrame]
_SOURCES: dict[str, Reader] = {}


def source(name: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        _SOURCES[name] = f
        return f

    return add


def read(spark: SparkSession, name: str, **options: object) -> DataFrame:
    """A DataFrame of a registered source; an unknown name is an error."""
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(_SOURCES)}")
    return _SOURCES[name](spark, **options)


def remove_source(name: str) -> bool:
    """False where there is no such source."""
    return _SOURCES.pop(name, None) is not None


def sources() -> list[str]:
    return sorted(_SOURCES)


def health(spark: SparkSession, name: str, **options: object) -> dict[str, object]:
    """name, healthy, error: whether the source can be opened and gives a row or none."""
    try:
        read(spark, name, **options).limit(1).count()
        return {"name": name, "healthy": True, "error": None}
    except Exception as e:  # whatever keeps the source from being read is the answer
        return {"name": name, "healthy": False, "error": f"{type(e).__name__}: {str(e)[:200]}"}


@source("text")
def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (MD5 of the path), file_path, file_type, text: one row a file (txt, md, html)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file_path"))
    return rows.select(F.md5("file_path").alias("doc_id"), "file_path", F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).alias("file_type"), "text")


@source("binary")
def binary_files(spark: SparkSession, path: str, extract: Callable | None = None) -> DataFrame:
    """Files as bytes; ``extract`` takes the DataFrame (path, content, length) to one with text, for formats such as PDF."""
    rows = spark.read.format("binaryFile").load(path)
    return extract(rows) if extract else rows


@source("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@source("json")
def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@source("jdbc")
def jdbc(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def converted(rows: DataFrame, convert: Callable[[str, str], str], key: str = "doc_id", text: str = "text", file_type: str = "file_type") -> DataFrame:
    """key, markdown, conversion_failed, error: ``convert(text, file_type)`` of each row; one that fails keeps its raw text, and the job goes on."""
    found = apply_or(rows, key, [text, file_type], convert, lambda x, _: x, "string")
    return found.select(key, F.col("value").alias("markdown"), F.col("error").isNotNull().alias("conversion_failed"), "error")


def write_text(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.col(text).alias("value")).write.text(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
