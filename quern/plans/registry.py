"""Registered queries: a Spark function and, where SQL can say it, the DuckDB text of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a data folder by name, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(x: Column) -> Column:
    """Sums of doubles depend on their order; compared values are rounded."""
    return F.round(x.cast("double"), 6)


#: Rows of a table that one task sorts or groups.
ROWS_EACH = 500_000


def parts_for(rows: DataFrame) -> int:
    """Parts to deal a table to so that what a task holds doesn't grow with it: a fixed number of rows each, and no fewer parts than a shuffle has anyway. Of a table in Parquet the count is in the footers."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_EACH + 1)


def big(x: Column) -> Column:
    return x.cast("long")
