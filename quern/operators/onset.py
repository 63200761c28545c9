"""Onsets of metric series: a written rule where the source of the semantics asks a language model.

A series that spikes (or appears) has its onset at the first sample, from the incident on, above
the mean plus DEVIATIONS standard deviations of what came before; with nothing or only zeros
before, at the first sample that is not zero. A series that collapses has it at the last sample
before the incident that is not zero, if none follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEVIATIONS = 3.0


def onsets(series: DataFrame, incidents: DataFrame, keys: Sequence[str], ts: str, value: str, at: str) -> DataFrame:
    """keys with spiked and collapsed, for every series that has an incident at column `at`: two aggregates and a join on the keys."""
    rows = series.join(incidents.select(*keys, at), list(keys))
    before, live = F.col(ts) < F.col(at), F.col(value) != 0
    old = F.when(before, F.col(value))
    base = rows.groupBy(*keys).agg(
        F.avg(old).alias("__mean"),
        F.coalesce(F.stddev_samp(old), F.lit(0.0)).alias("__dev"),
        F.coalesce(F.bool_or(before & live), F.lit(False)).alias("__was"),
        F.max(F.when(before & live, F.col(ts))).alias("__last"),
        F.coalesce(F.bool_or(~before & live), F.lit(False)).alias("__is"),
    )
    above = F.when(F.col("__was"), F.col(value) > F.col("__mean") + DEVIATIONS * F.col("__dev")).otherwise(live)
    found = rows.join(base, list(keys)).groupBy(*keys).agg(F.min(F.when(~before & above, F.col(ts))).alias("spiked"))
    return found.join(base.select(*keys, F.when(~F.col("__is"), F.col("__last")).alias("collapsed")), list(keys))
