"""Spark sessions with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "docloom", cores: int | str = "*", warehouse: str | None = None, **conf: str) -> SparkSession:
    """A session of this machine's own; on a cluster, use the session that spark-submit configures."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the DataFrames that need them
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
