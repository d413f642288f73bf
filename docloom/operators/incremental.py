"""Re-processing of what has changed: versions of documents compared by hashes of their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.catalog import Collections

#: Fixed value: share of changed chunks over which a document is processed anew.
REPROCESS = 0.5


def hashed_chunks(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    """key, pos, hash of every chunk."""
    return docs.select(key, F.posexplode(chunks).alias("pos", "chunk")).select(key, "pos", F.md5("chunk").alias("hash"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, hash, change: added, removed or unchanged, by sets of hashes."""
    a, b = old.select(key, "hash").distinct().withColumn("a", F.lit(1)), new.select(key, "hash").distinct().withColumn("b", F.lit(1))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, [key, "hash"], "full").select(key, "hash", change.alias("change"))


def status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status, n_added, n_removed, n_unchanged.

    Removed counts are over old positions, the others over new ones; documents
    without old chunks are ``new``, and with more changes than half of the new
    chunks ``reprocess``.
    """
    changes = diff(old, new, key)
    in_new = new.join(changes, [key, "hash"]).groupBy(key).agg(F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "unchanged").alias("n_unchanged"), F.count("*").alias("n_new"))
    in_old = old.join(changes, [key, "hash"]).groupBy(key).agg(F.count_if(F.col("change") == "removed").alias("n_removed"), F.count("*").alias("n_old"))
    both = in_new.join(in_old, key, "full").na.fill(0)
    changed = F.col("n_added") + F.col("n_removed")
    what = F.when(F.col("n_old") == 0, "new").when(changed == 0, "unchanged").when(changed > F.col("n_new") * REPROCESS, "reprocess").otherwise("update")
    return both.select(key, what.alias("status"), "n_added", "n_removed", "n_unchanged")


def changed(state: DataFrame, docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of ``docs`` that have no state or differ from it in one of ``columns`` (null equals null)."""
    before = state.select(key, F.lit(1).alias("_known"), *(F.col(c).alias(f"_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return docs.join(before, key, "left").filter(F.col("_known").isNull() | ~same).select(*docs.columns)


def added_lines(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, n: lines that the new text has more often than the old one, and how many more."""
    count = lambda df, n: df.select(key, F.explode(F.split(text, "\n")).alias("line")).groupBy(key, "line").agg(F.count("*").alias(n))
    both = count(new, "n_new").join(count(old, "n_old"), [key, "line"], "left")
    return both.withColumn("n", F.col("n_new") - F.coalesce("n_old", F.lit(0))).filter("n > 0").select(key, "line", "n")


class State:
    """What is known of processed documents, kept between runs as the collection ``name`` (key and ``columns``)."""

    def __init__(self, kept: Collections, name: str, key: str, *columns: str):
        self.kept, self.name, self.key, self.columns = kept, name, key, columns

    def due(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` that are new, or differ from the last run."""
        return changed(self.kept.read(self.name), docs, self.key, *self.columns) if self.kept.exists(self.name) else docs

    def done(self, docs: DataFrame) -> None:
        """Notes that ``docs`` have been processed as they are now."""
        rows = docs.select(self.key, *self.columns)
        if self.kept.exists(self.name):
            self.kept.upsert(self.name, rows, self.key)
        else:
            self.kept.create(self.name, rows)
