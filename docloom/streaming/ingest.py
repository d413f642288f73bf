"""Ingestion by micro-batches with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.streaming.changes import last_changes


def ingest(spark: SparkSession, source: str, target: str, key: str, files_per_batch: int = 100, order: str | None = None) -> DataFrame:
    """Everything in ``source`` (Parquet) appended to ``target`` in micro-batches, each batch once; returns the rows of ``target``, one for each key.

    Of rows of one key the last by ``order`` stays, and without one, or of equal ones, that whose columns are larger.

    A batch goes to a folder of its own number, so one that is run again after a
    failure replaces what it had written.
    """
    known = spark.read.parquet(source)
    schema, stream = known.schema, spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    parent, _, name = source.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in known.inputFiles()] == [name]:  # a single file; streams read folders
        stream, source = stream.option("pathGlobFilter", name), parent
    stream = stream.schema(schema).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        last_changes(batch, key, [order] if order else []).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    job = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(schema).parquet(f"{target}/rows").transform(lambda rows: last_changes(rows, key, [order] if order else []))


def windowed(events: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts of ``events`` in windows of ``size``, with rows up to ``late`` behind accepted; for batches and streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))
