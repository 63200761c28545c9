"""Writers. Spark's committers make each write whole or absent; small tables are rendered on the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text


def workspace(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Without that setting a temporary one, which only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-work-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a table in the shared folder, read again: for what a plan needs several times, and to cut lineage."""
    path = workspace(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def json_by(rows: DataFrame, path: str, key: str) -> None:
    """One folder of JSON per entity."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def csv_table(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file; arrays are joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if k.startswith("array") else F.col(c) for c, k in rows.dtypes]
    rows.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def csv_by(rows: DataFrame, path: str, key: str) -> None:
    """One folder of CSV per entity, written by one task; arrays are written as Python lists, as older runs have them. Tasks share the folders, of which each is a file to open and close."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flat = [text.written_list(F.col(c)).alias(c) if k.startswith("array") else F.col(c) for c, k in rows.dtypes]
    rows.select(*flat).repartition(n, key).write.mode("overwrite").partitionBy(key).option("header", True).option("escape", '"').csv(path)


def todo(work: DataFrame, done: DataFrame, keys: list[str], retry: str | None = None) -> DataFrame:
    """Work that is not done; with retry, a boolean column of done, also what is done but marked to be done again."""
    settled = done if retry is None else done.where(~F.coalesce(F.col(retry), F.lit(False)))
    return work.join(settled.select(*keys), keys, "left_anti")


def fingerprint(*fields: str) -> Column:
    """SHA-1 of what a step depends on, as JSON with sorted keys."""
    return F.sha1(F.to_json(F.struct(*sorted(fields))))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def mean_cell(mean: float | None, sem: float | None) -> str:
    """12.3% and, if there is an error, its half width; a dash for nothing. From unrounded numbers."""
    if mean is None:
        return "—"
    return f"{mean:.1f}%" if sem is None else f"{mean:.1f}% ± {sem:.1f}%"


def padded_cell(mean: float, sem: float, width: int = 5) -> str:
    """Mean and error in columns of equal width."""
    return f"{mean:>{width}.1f} ± {sem:>{width - 1}.1f}"


def resource_cells(tokens: int | None, dollars: float | None) -> tuple[str, str]:
    """Totals as 1,234 and $5.60; a dash for what nothing reported."""
    return "—" if tokens is None else f"{tokens:,}", "—" if dollars is None else f"${dollars:,.2f}"


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than `limit` rows are an error, not cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"over {limit} rows")
    show = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in found])
