"""Tables of one directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.storage import file_system

#: Tables of long texts, whose rows are worth dealing out before they are worked on.
LONG = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where it is so few files that most cores would have nothing to do.

    A file of one row group is one task.  Large tables have more files than half
    the cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # their number only; the names stay in the JVM
    return df.repartition(2 * cores) if 2 * files <= cores else df


#: Rows of a task where each row takes long.
FEW_ROWS = 2000


def dealt(df: DataFrame, key: str, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, two a core at least, so that no task grows with the table; for work that costs far more than this shuffle."""
    n = df.count()
    return df.repartition(max(-(-n // rows), min(2 * df.sparkSession.sparkContext.defaultParallelism, n), 1), key)


class Tables:
    """``tables.documents`` reads documents.parquet, and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def names(self) -> list[str]:
        """The tables that the folder holds."""
        fs, where = file_system(self.spark, self.folder)
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(where) if s.getPath().getName().endswith(".parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in LONG else df
