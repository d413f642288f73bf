"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but ids of a fixed width; each document ends with the
end-of-document id.  The scan reads a file in blocks, finds the separators of
each block with vectorised comparisons, and joins the blocks by a prefix scan
(a running maximum of the last separator, a running sum of the counts), so a
document may lie across any number of blocks.

Two separators in a row are an empty document.  A last document without a
separator counts, with ``closed`` false; an empty file has no documents.  A
file whose size isn't a multiple of the width is an error.

Files may have any size.  Spark's text reader hands out their bytes split by
split, in records that are joined to blocks again.  A split may begin between the
bytes of an id, so a block is compared from each byte of an id on, and what isn't
the beginning of one is dropped when the prefix scan has told the block's place.
No task holds more than a batch of records; a record is about a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import encoded
from docloom.llm.common import bounded, cut, work_dir
from docloom.storage import remove

#: Tokens of one block of the scan.
BLOCK = 1 << 16


def _text(mark: bytes) -> dict[str, str]:
    """Options of Spark's text files for rows that end with ``mark``."""
    return {"lineSep": mark.decode("latin-1"), "encoding": "ISO-8859-1"}


def _record_end(mark: bytes) -> bytes:
    """What ends a record of the reader: ``mark``, or, if one could begin within another, a byte that isn't in it.  So none lies across two records."""
    if any(mark.startswith(mark[k:]) for k in range(1, len(mark))):
        return bytes([next(b for b in range(255, -1, -1) if b not in mark)])
    return mark


def write_token_files(docs: DataFrame, folder: str, path: str, separator: int, dtype: str = "<u2") -> None:
    """Writes the ids of ``docs`` (doc_id, text; null text: empty) to ``folder``/kind=tokens, one flat file a task.

    Special tokens' texts are ordinary text, so no separator stands inside a
    document.  ``folder``/kind=names lists the ordinals and doc_ids of the file of
    the same name.  Spark's text writer puts the separator's bytes after each row.
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch, ids in encoded(batches, path, specials=False):
            n = batch.num_rows
            if any(len(x) and x.max() >= 256**width for x in ids):
                raise ValueError(f"ids don't fit into {dtype}")
            names = [f"{at + i} {'' if x is None else x}" for i, x in enumerate(batch.column("doc_id").to_pylist())]
            rows = [x.astype(dtype).tobytes() for x in ids] + [x.encode() for x in names]
            yield pa.record_batch([pa.array(["tokens"] * n + ["names"] * n), pa.array([*range(at, at + n)] * 2, pa.int64()), pa.array(rows, pa.binary())], ["kind", "at", "value"])
            at += n

    rows = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "kind string, at long, value binary").sortWithinPartitions("kind", "at")
    rows = rows.select("kind", F.col("value").cast("string"))
    rows.write.partitionBy("kind").options(**_text(int(separator).to_bytes(width, "little"))).text(folder)


def scan_token_files(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Each document of the token files in ``folder``: file, ordinal (from 0), start, n_tokens (without the separator), closed."""
    width = np.dtype(dtype).itemsize
    end = _record_end(int(separator).to_bytes(width, "little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, k = None, 0  # a split and its next block
        for batch in batches:
            key = [batch.column(c).to_pylist() for c in ("file", "size", "split")]
            for (file, size, split), rows in groupby(zip(*key, batch.column("record").to_pylist()), lambda x: x[:3]):
                if size % width:
                    raise ValueError(f"{file} has {size} bytes, which isn't a multiple of {width}")
                if (file, split) != place:
                    place, k = (file, split), 0
                raw = b"".join(x[3] for x in rows)
                ends = [np.flatnonzero(np.frombuffer(raw, dtype, (len(raw) - i) // width, i) == separator) * width + i for i in range(min(width, len(raw)))]
                ends, lows = np.sort(np.concatenate(ends)), np.arange(0, len(raw), block * width)
                parts, highs = np.split(ends, np.searchsorted(ends, lows[1:])), np.append(lows[1:], len(raw))
                n, of_blocks = len(lows), pa.array([x - low for x, low in zip(parts, lows)], pa.list_(pa.int64()))
                each = [pa.array([x] * n) for x in (file, size, split)]
                yield pa.record_batch([*each, pa.array(range(k, k + n), pa.int64()), pa.array(highs - lows), of_blocks], ["file", "size", "split", "block", "n", "ends"])
                k += n

    meta = F.col("_metadata")
    record = F.concat(F.col("value").cast("binary"), F.lit(end)).alias("record")
    records = spark.read.options(**_text(end)).text(folder).select(meta.file_name.alias("file"), meta.file_size.alias("size"), meta.file_block_start.alias("split"), record)
    blocks = bounded(records).mapInArrow(run, "file string, size long, split long, block long, n long, ends array<long>")
    whole = Window.partitionBy("file")
    before = whole.orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    # a last record without an end has got one; three first bytes that look like a text's byte order mark are left out by the reader
    read, more = F.sum("n").over(whole), F.col("read") - F.col("size")
    skipped = F.when(more.isin(-3, len(end) - 3), 3).when(more.isin(0, len(end)), 0).otherwise(F.raise_error(F.concat(F.lit("not read as it is: "), "file")))
    placed = blocks.withColumns({"read": read, "at": F.coalesce(F.sum("n").over(before), F.lit(0))})
    placed = placed.withColumns({"last": F.col("at") + F.col("n") == F.col("read"), "at": F.col("at") + skipped, "n": F.expr(f"size div {width}")})
    placed = placed.withColumn("ends", F.transform("ends", lambda x: x + F.col("at")))
    placed = placed.withColumn("ends", F.filter("ends", lambda x: (x % width == 0) & (x + width <= F.col("size"))))
    placed = placed.withColumn("ends", F.expr(f"transform(ends, x -> x div {width})"))
    latest = F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)
    stitched = placed.withColumns({"first": F.coalesce(F.max(latest).over(before) + 1, F.lit(0)), "base": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))})
    stitched = stitched.withColumn("is_open", F.col("last") & (F.coalesce(latest + 1, F.col("first")) < F.col("n")))
    stitched = stitched.withColumn("ends", F.when(F.col("is_open"), F.array_append("ends", F.col("n"))).otherwise(F.col("ends")))
    each = stitched.select("file", "base", "first", "ends", "is_open", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("first")).otherwise(F.expr("ends[k - 1] + 1"))
    return each.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (~(F.col("is_open") & (F.col("k") == F.size("ends") - 1))).alias("closed"))


def names_of_token_files(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, doc_id, as ``write_token_files`` has listed them."""
    mark = int(separator).to_bytes(np.dtype(dtype).itemsize, "little")
    return spark.read.options(**_text(mark)).text(folder).select(F.col("_metadata").file_name.alias("file"), F.substring_index("value", " ", 1).cast("long").alias("ordinal"), F.substring_index("value", " ", -1).try_cast("long").alias("doc_id"))


def token_counts(docs: DataFrame, path: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """Writes ``docs`` as token files into the shared folder, scans them: doc_id, n_tokens, file_no, ordinal, start.

    The files are removed once the result is kept by a checkpoint.  One row for each row of ``docs``; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    write_token_files(docs, folder, path, separator, dtype)
    if not docs.take(1):
        return spark.createDataFrame([], "doc_id long, n_tokens long, file_no int, ordinal long, start long")
    found = scan_token_files(spark, f"{folder}/kind=tokens", separator, dtype)
    names = names_of_token_files(spark, f"{folder}/kind=names", separator, dtype)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("file_no")
    out = cut(found.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", number, "ordinal", "start"))
    remove(spark, folder)
    return out
