"""Connected components of a distributed edge list by alternating large and small stars.

Each round rewires edges towards the smallest neighbour seen: large stars link a node's
larger neighbours to its minimum, small stars link its smaller ones. Minima are combined
before the shuffle and joined back, so that the hub of a large component is never gathered
in one row. Every round is a written table in the shared folder; the driver sees two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, written


def _large(e: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v. For each node: its larger neighbours linked to its minimum (itself included)."""
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """For each node: its smaller neighbours and itself linked to its minimum."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the smallest node reachable. Nodes without edges don't appear; nulls and loops are ignored."""
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = written(pairs, "edges"), None
    while True:
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == last or not row[0]:
            break
        last, before = tuple(row), now
        now = written(_small(_large(now)), "edges")
        forget(spark, before)
    # At the fixed point every edge points at its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
