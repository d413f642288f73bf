"""Exact deduplication by content sort, with DataFrame functions only.

Normalised texts are dealt out by range, with splitters that Spark samples;
each task sorts its range outside memory if need be, equal texts come to stand
next to each other, and the window compares neighbours in full.  Splitters are
the beginnings of texts, and hashes for texts that begin alike, so that what the
driver gets is small.

A text with very many copies would fill one range.  A count of 64-bit hashes
finds the texts with more rows than a quarter of an even range; there are at
most four times as many of them as ranges, so that list is broadcast.  Their
rows get a salt as second sort key; of each salted run the best row and the
count go on, and a second, small content sort joins the runs of a text.

Null text is the empty text.  A null doc_id counts as larger than any other.
Rows that agree in everything are copies of each other: one stays.  An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The characters that don't count, SPACE and TAB to CARRIAGE RETURN.
BLANK = " \t\n\v\f\r"
#: Characters of a text that a splitter has.
BEGINNING = 32


def without_blanks(text: Column) -> Column:
    for c in BLANK:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def content_sort(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts, the one with the longest original text
    stays, then the one with the smallest ``key``.
    """
    spark = docs.sparkSession
    original = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("doc_id"), original.alias("original"))
    rows = rows.select("doc_id", F.length("original").cast("long").alias("n"), without_blanks(F.col("original")).alias("norm"))

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count("*").alias("copies"))
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total"))
    # more than total / (4 ranges) rows and 256: at most 4 ranges rows
    hot = counts.filter("copies > 256").join(F.broadcast(total), F.col("copies") * 4 * ranges > F.col("total"))
    hot = hot.select("h", F.ceil(F.col("copies") * 8 * ranges / F.col("total")).cast("int").alias("salts"))

    salted = rows.withColumn("h", F.xxhash64("norm")).join(F.broadcast(hot), "h", "left")
    salted = salted.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id", "n"), F.col("salts"))).otherwise(F.lit(-1)))
    head = F.substring("norm", 1, BEGINNING).alias("head")
    dealt = salted.select(head, "norm", "h", "salt", "doc_id", "n").repartitionByRange("head", "h", "salt")
    run = Window.partitionBy("head", "norm", "salt", "h")
    best = run.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    placed = dealt.select(
        "doc_id",
        "head",
        "h",
        "salt",
        F.row_number().over(best).alias("place"),
        F.first("doc_id").over(best).alias("keep_id"),
        F.first("n").over(best).alias("keep_n"),
        F.count("*").over(run).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.when((F.col("salt") >= 0) & (F.row_number().over(best) == 1), F.col("norm")).alias("norm"),
    )

    runs = placed.filter("norm is not null").select("head", "norm", "h", "text_sha256", "salt", "keep_id", "keep_n", "group_size").repartitionByRange("head", "h")
    same = Window.partitionBy("head", "norm", "h")
    first = same.orderBy(F.desc("keep_n"), F.asc_nulls_last("keep_id"), "salt")
    whole = runs.select("text_sha256", F.first("keep_id").over(first).alias("w_id"), F.first("salt").over(first).alias("w_salt"), F.sum("group_size").over(same).alias("w_size")).distinct()
    joined = placed.drop("head", "norm", "h").join(F.broadcast(whole), "text_sha256", "left")  # as many rows as hot texts
    mine = F.col("w_salt").isNull() | (F.col("w_salt") == F.col("salt"))
    return joined.select(
        "doc_id",
        F.when(F.col("w_salt").isNull(), F.col("keep_id")).otherwise(F.col("w_id")).alias("keep_id"),
        F.coalesce("w_size", "group_size").alias("group_size"),
        ((F.col("place") == 1) & mine).alias("kept"),
        "text_sha256",
    )
