"""Metadata without a schema, as VARIANT columns: fields are read, filtered and deleted by without a declaration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalog import Collections
from docloom.storage import fresh_folder


def collection(spark: SparkSession, name: str) -> Collections:
    """Collections in a fresh folder of the shared place."""
    return Collections(spark, fresh_folder(spark, name))


def with_metadata(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` with the JSON strings of one column as VARIANT; what isn't JSON becomes null."""
    return rows.withColumn(json, F.try_parse_json(F.col(json)))


def field(metadata: str, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT column; null where it is missing or not of that kind."""
    escaped = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(F.col(metadata), f"$['{escaped}']" if "'" in name else f'$["{name}"]', kind)
