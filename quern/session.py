"""SparkSession factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quern", cores: int | None = None) -> SparkSession:
    """A session with the settings the engine assumes (UTC, AQE). Where the submission names no master it is a local one with `cores` threads, whose listings of large trees take few tasks."""
    builder = SparkSession.builder.appName(app)
    if not (os.environ.get("SPARK_MASTER") or os.environ.get("MASTER") or SparkSession.getActiveSession() or _submitted()):
        cores = cores or os.cpu_count() or 8
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * cores)).config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _submitted() -> bool:
    """Whether spark-submit started this process and has set a master."""
    from pyspark import SparkConf, SparkContext

    return SparkContext._gateway is not None and SparkConf(loadDefaults=True).contains("spark.master")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
