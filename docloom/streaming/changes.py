"""A table kept up to date by a stream of inserts, updates and deletes.

Every change carries an order, and the last change of a key by that order wins,
whenever it arrives: late changes and repeated ones alter nothing.  A micro-batch is
reduced to the last change of each key and written to a folder of its own number, so
a batch that is run again after a failure replaces itself.  Reading merges these
folders; ``compact`` merges them into one, with deletes kept as rows so that older
changes that are still to come lose against them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.storage import file_system, remove


def last_changes(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key; of changes of one order the one whose other columns are larger."""
    whole = F.struct(*changes.columns)
    rank = F.struct(*order, *(c for c in changes.columns if c not in order))
    return changes.groupBy(key).agg(F.max_by(whole, rank).alias("_last")).select("_last.*")


class ChangedTable:
    """The table in ``folder`` with the columns of ``schema``, among them ``key``, ``op`` and those of ``order``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, order: Sequence[str], op: str = "op", delete: str = "delete"):
        self.spark, self.folder, self.schema, self.key, self.order, self.op, self.delete = spark, folder.rstrip("/"), schema, key, list(order), op, delete

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the folders there that have been written to the end."""
        fs, where = file_system(self.spark, f"{self.folder}/{name}")
        if not fs.exists(where):
            return []
        done = lambda path: fs.exists(file_system(self.spark, f"{path}/_SUCCESS")[1])
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(where) if "=" in s.getPath().getName() and done(s.getPath().toString()))

    def put(self, batch: DataFrame, number: int) -> None:
        """Adds the changes of a batch; putting a number again replaces it."""
        last_changes(batch.select(*self.schema.names), self.key, self.order).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")

    def follow(self, source: str, files_per_batch: int = 100) -> None:
        """Takes in what is new in the folder ``source`` (Parquet files of changes), in batches, each once; goes on where the last call ended or failed."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        job = stream.writeStream.foreachBatch(self.put).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        job.awaitTermination()

    def _merged(self) -> tuple[DataFrame, int, list[int]]:
        upto = max(self._numbers("base"), default=-1)
        batches = self._numbers("changes")
        paths = [f"{self.folder}/base/upto={upto}"] * (upto >= 0) + [f"{self.folder}/changes/batch={n}" for n in batches if n > upto]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return last_changes(rows, self.key, self.order), upto, batches

    def current(self) -> DataFrame:
        """The table as it is now: the last change of every key that isn't deleted."""
        return self._merged()[0].filter(~F.col(self.op).eqNullSafe(F.lit(self.delete)))

    def compact(self) -> None:
        """Merges all batches so far; readers that have begun before should be done."""
        rows, upto, batches = self._merged()
        if not batches or batches[-1] <= upto:
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/base/upto={batches[-1]}")
        for n in batches:
            remove(self.spark, f"{self.folder}/changes/batch={n}")
        if upto >= 0:
            remove(self.spark, f"{self.folder}/base/upto={upto}")
