"""Maintenance of collections: DataFrame in, DataFrame out; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``old`` and ``rows``; rows without a key get a random one."""
    made = F.coalesce(F.col(key).cast("string"), F.expr("uuid()")) if rows.schema[key].dataType.simpleString() == "string" else F.col(key)
    return old.unionByName(rows.withColumn(key, made), allowMissingColumns=True)


def upsert(old: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, and those of ``old`` with other keys."""
    return old.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.distinct(), keys.columns, "left_anti")


def get(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.distinct(), keys.columns, "left_semi")


def clear(old: DataFrame) -> DataFrame:
    return old.filter(F.lit(False))


def delete_result(old: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key with deleted: whether there was a row."""
    (key,) = keys.columns
    there = old.select(key).distinct().withColumn("_there", F.lit(True))
    return keys.distinct().join(there, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("deleted"))


def wrong_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    return rows.filter(F.col(vector).isNull() | (F.size(vector) != dim))


def stats(rows: DataFrame, vector: str) -> DataFrame:
    """One row: row_count, min_dim, max_dim."""
    return rows.agg(F.count("*").alias("row_count"), F.min(F.size(vector)).cast("long").alias("min_dim"), F.max(F.size(vector)).cast("long").alias("max_dim"))


def add_missing(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``old``, and those of ``rows`` whose key it lacks."""
    return old.unionByName(rows.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def request_errors(requests: DataFrame, vectors: str = "vectors", ids: str = "ids", metadata: str = "metadata", dim: int | None = None) -> Column:
    """What keeps a request from being inserted, null where nothing does: no vectors, lists of different lengths, vectors of another dimension or of several."""
    n = F.size(vectors)
    sizes = F.array_distinct(F.transform(vectors, lambda v: F.coalesce(F.size(v), F.lit(-1))))
    return (
        F.when(F.col(vectors).isNull() | (n == 0), "no vectors")
        .when(F.col(ids).isNotNull() & (F.size(ids) != n), F.concat(F.size(ids).cast("string"), F.lit(" ids for "), n.cast("string"), F.lit(" vectors")))
        .when(F.col(metadata).isNotNull() & (F.size(metadata) != n), F.concat(F.size(metadata).cast("string"), F.lit(" metadata for "), n.cast("string"), F.lit(" vectors")))
        .when((F.size(sizes) > 1) | F.exists(vectors, lambda v: v.isNull()), "vectors of several dimensions")
        .when(F.lit(dim).isNotNull() & (F.get(sizes, F.lit(0)) != F.lit(dim)), F.concat(F.lit("vectors of dimension "), F.get(sizes, F.lit(0)).cast("string")))
    )


def request_rows(requests: DataFrame, key: str, vectors: str = "vectors", ids: str = "ids", metadata: str = "metadata") -> DataFrame:
    """key, pos, id, vector, text, metadata of the requests that can be inserted: an id that isn't given is random, the text is the metadata's field of that name (JSON)."""
    good = requests.filter(request_errors(requests, vectors, ids, metadata).isNull())
    each = good.select(key, F.col(ids).alias("_ids"), F.col(metadata).alias("_meta"), F.posexplode(vectors).alias("pos", "vector"))
    own = F.get("_meta", F.col("pos"))
    made = F.coalesce(F.get("_ids", F.col("pos")).cast("string"), F.expr("uuid()"))
    return each.select(key, F.col("pos").cast("long").alias("pos"), made.alias("id"), "vector", F.coalesce(F.get_json_object(own, "$.text"), F.lit("")).alias("text"), own.alias("metadata"))
