"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import fresh_folder
from docloom.tables import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return getattr(Tables(spark, sf_dir), name)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null is the empty text, bytes that aren't UTF-8 are replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one holds about ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def hot_keys(counts: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """keys, salts: those keys of ``counts`` (keys, n) with more rows than a quarter of an even partition, and into how many parts to deal them.

    There are at most four times as many of them as shuffle partitions, so the list may be broadcast.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    hot = counts.filter(F.col(n) > 256).crossJoin(F.broadcast(total)).filter(F.col(n) * 4 * parts > F.col("_total"))  # one row
    return hot.select(*keys, F.ceil(F.col(n) * 4 * parts / F.col("_total")).cast("int").alias("_salts"))


def salted_join(rows: DataFrame, found: DataFrame, hot: DataFrame, keys: list[str], row: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` (one row for each of ``keys``); rows of ``hot`` keys are dealt out by a salt from the columns ``row``."""
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*row), F.col("_salts"))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1))
    copies = found.join(F.broadcast(hot), keys, "left").withColumn("_salt", every).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


#: Rows of an Arrow batch between Spark and Python: texts are long, so fewer than Spark's own number.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Arrow batches of ``BATCH_ROWS`` rows at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place that the cluster names in ``spark.checkpoint.dir``; an error where a cluster names none."""
    return fresh_folder(spark, name)


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    Spark's cleaner drops the shuffle files of earlier lineage once the driver's
    Python and JVM have collected its plan as garbage.  ``free`` asks for that at
    once, after large shuffles: pass ``df`` without keeping it; its own files go
    with the next such call.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoint"))
    out = df.checkpoint(eager=True)
    del df
    for _ in range(2 if free else 0):  # plans are held by Python objects in cycles, these by JVM objects
        gc.collect()
        context._jvm.System.gc()
        time.sleep(0.3)
    return out
