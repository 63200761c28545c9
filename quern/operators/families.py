"""Metric families and what is said about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_key(labels: Column) -> Column:
    """Label pairs as JSON with sorted keys: equal label sets have equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(labels)))


def annotated(families: DataFrame, notes: DataFrame) -> DataFrame:
    """families (family, labels) with the layer of the note on the same family and labels, else of the first note (by place) on the family, else unknown.

    notes: family, labels, place, layer; the last of several notes on the same pair counts.
    """
    exact = notes.groupBy("family", label_key(F.col("labels")).alias("__k")).agg(F.max_by("layer", "place").alias("__exact"), F.min("place").alias("__place"))
    named = exact.groupBy("family").agg(F.min_by("__exact", "__place").alias("__named"))
    rows = families.withColumn("__k", label_key(F.col("labels"))).join(exact.drop("__place"), ["family", "__k"], "left").join(named, "family", "left")
    return rows.select(*families.columns, F.coalesce("__exact", "__named", F.lit("unknown")).alias("layer"))


def conclusive(kind: Column) -> Column:
    """Whether a variant's type doesn't call it inconclusive."""
    return ~F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("inconclusive"))


def run_file(name: Column, flag: Column, derived: bool = True) -> Column:
    """Whether a file holds a run's metrics of exactly that flag: metrics-<flag>-<digits>-....json. derived: merged and labelled files count too."""
    rest = F.substr(name, F.length(flag) + 10)
    own = name.startswith(F.concat(F.lit("metrics-"), flag, F.lit("-"))) & rest.rlike(r"^[0-9]+-.*\.json$")
    return own if derived else own & ~F.contains(name, F.lit("-merged")) & ~F.contains(name, F.lit("-labeled"))
