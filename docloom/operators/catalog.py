"""Named collections in one folder: create, drop, list, read, and changes as safe rewrites.

A change writes the whole collection to a folder of its own version and then a small
file that names it, numbered one higher than the one before.  That file appears
whole or not at all and never replaces another, so readers see the old rows or the
new ones, a job that fails leaves the old ones, and of two writers that began with
the same version one gets ``ChangedMeanwhile``.  The version before the current one
stays, for readers that have begun with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import collection as K
from docloom.storage import file_system, put_new, remove


class ChangedMeanwhile(RuntimeError):
    """Another writer has changed the collection since this one read it; nothing was written."""


class Collections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self, name: str) -> list[int]:
        """Numbers of the commits that are kept: the current one comes last."""
        fs, where = file_system(self.spark, f"{self.root}/{name}/commits")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def _version(self, name: str, commit: int) -> str:
        return self.spark.read.text(f"{self.root}/{name}/commits/{commit:012}").first().value

    def _path(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/version={version}"

    def names(self) -> list[str]:
        fs, where = file_system(self.spark, self.root)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if self.exists(n))

    def exists(self, name: str) -> bool:
        return bool(self._commits(name))

    def create(self, name: str, rows: DataFrame) -> None:
        """A new collection of ``rows``; one of that name is an error."""
        if self.exists(name):
            raise ValueError(f"there is a collection {name!r}")
        self.write(name, rows)

    def drop(self, name: str) -> bool:
        """False where there is no such collection."""
        return remove(self.spark, f"{self.root}/{name}")

    def _current(self, name: str) -> int:
        commits = self._commits(name)
        if not commits:
            raise ValueError(f"no collection {name!r}")
        return commits[-1]

    def _rows(self, name: str, commit: int) -> DataFrame:
        return self.spark.read.parquet(self._path(name, self._version(name, commit)))

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self._current(name))

    def write(self, name: str, rows: DataFrame, after: int | None = None) -> None:
        """``rows`` as the collection's new version; ``after`` is the commit that they were made from, the current one if it isn't given."""
        commits, new = self._commits(name), uuid.uuid4().hex
        base = after if after is not None else (commits[-1] if commits else 0)
        rows.write.parquet(self._path(name, new))
        own = f"{self.root}/{name}/commits/{base + 1:012}"
        try:
            put_new(self.spark, own, new)
            late = self._commits(name)[-1] > base + 1  # the place was free because old commits go
        except FileExistsError:
            own, late = None, True
        if late:
            if own:
                remove(self.spark, own)
            remove(self.spark, self._path(name, new))
            raise ChangedMeanwhile(f"{name!r} has been changed since it was read")
        for commit in commits[:-1]:
            old = self._version(name, commit)
            remove(self.spark, f"{self.root}/{name}/commits/{commit:012}")
            remove(self.spark, self._path(name, old))

    def _change(self, name: str, made: Callable[[DataFrame], DataFrame]) -> None:
        commit = self._current(name)
        self.write(name, made(self._rows(name, commit)), commit)

    def compact(self, name: str, rows_per_file: int = 1_000_000) -> None:
        """The same rows in files of about ``rows_per_file`` rows."""
        self._change(name, lambda old: old.repartition(max(1, -(-old.count() // rows_per_file))))

    def delete_where(self, name: str, condition: Column) -> None:
        """Without the rows for which ``condition`` holds; those for which it is null stay."""
        self._change(name, lambda old: old.filter(~F.coalesce(condition, F.lit(False))))

    def insert(self, name: str, rows: DataFrame, key: str) -> None:
        self._change(name, lambda old: K.insert(old, rows, key))

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> None:
        self._change(name, lambda old: K.upsert(old, rows, *keys))

    def delete(self, name: str, keys: DataFrame) -> None:
        self._change(name, lambda old: K.delete(old, keys))

    def listing(self) -> DataFrame:
        """collection, n_rows."""
        none = self.spark.createDataFrame([], "collection string, n_rows long")
        for name in self.names():
            none = none.unionByName(self.read(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("collection"), "n_rows"))
        return none
