"""Sharding by rendezvous hashing (native: DataFrame functions only).

Every record key gets one score per shard, a pure function of key, shard and weight; the
record goes to the shard with the highest score. Adding a shard adds one score, so records
move only into the new shard; raising a weight moves records only into that shard.

Slots number a shard's records from 0 without gaps and without one task per shard: records
are counted by (shard, bucket), where the bucket is a hash of the record; a running sum over
those few counts gives each bucket's first slot; rows are numbered inside their bucket.
Repeated rows are counted before anything is dealt out and expanded at the end.

Null ids hash like any other value (a defined constant), null texts have size 8 and
CRC-32 0, an empty table gives no rows; only doc_id and text are read, so that other
columns of whatever name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a shard is to hold, about.
BUCKET_ROWS = 50_000
#: Slots of equal rows that are made at once.
RUN = 10_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards: the argument of the highest score.

    Score of shard i: -w_i / ln(u_i), u_i uniform in (0, 1) from a hash of (key, i); a shard is
    chosen with probability w_i / sum(w). Ties go to the higher shard number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")

    def scored(i: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.lit(float(w)) / F.log(u)).alias("score"), F.lit(i).alias("shard"))

    picks = [scored(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*picks) if len(picks) > 1 else picks[0])["shard"]


def with_slots(rows: DataFrame, shard: str, content: Sequence[str], n_rows: int, n_shards: int) -> DataFrame:
    """rows with slot: gapless from 0 in each shard. content: columns that fix a row's place; rows that are equal in them are interchangeable."""
    buckets = max(1, n_rows // n_shards // BUCKET_ROWS)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__b", F.pmod(F.xxhash64(*content), F.lit(buckets)))
    sums = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(F.col(shard).alias("__s"), F.col("__b").alias("__c"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__b").orderBy(*content).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__k", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    numbered = numbered.join(firsts, (F.col(shard) == F.col("__s")) & (F.col("__b") == F.col("__c")))
    first, last = F.col("__first") + F.col("__k"), F.col("__first") + F.col("__k") + F.col("__n") - 1
    # Many equal rows are dealt out run by run: no array is longer than RUN.
    runs = numbered.select(*rows.columns, last.alias("__last"), F.explode(F.sequence(first, last, F.lit(RUN).cast("long"))).alias("__from"))
    return runs.select(*rows.columns, F.explode(F.sequence("__from", F.least(F.col("__from") + RUN - 1, "__last"))).alias("slot"))


def shard(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every document."""
    weights = list(weights or [1.0] * n_shards)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"], docs.select("doc_id").count(), len(weights))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
