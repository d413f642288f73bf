"""The shared folder for intermediate data, and what is done there.

On a cluster it is the folder named by ``spark.checkpoint.dir``, which driver and
executors share; without that setting only a local session may use the warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate data needs a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of ``path``, and the path as its object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder with all it holds; false where there is none."""
    fs, where = file_system(spark, path)
    return fs.exists(where) and fs.delete(where, True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all; ``FileExistsError`` where there is one already."""
    fs, where = file_system(spark, path)
    fs.mkdirs(where.getParent())
    early = where.getParent().suffix(f"/.{uuid.uuid4().hex}")
    out = fs.create(early, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    none = gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:  # unlike the file system's own, this rename never replaces a file
        hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(early), fs.makeQualified(where), none)
    except Exception as e:
        fs.delete(early, False)
        if "FileAlreadyExistsException" in str(e):
            raise FileExistsError(path) from e
        raise


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept by a reliable checkpoint, so that its sources may go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(fresh_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
