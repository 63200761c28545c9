"""Stratified splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import sinks


def draw(seed: int, *keys: Column) -> Column:
    """A number of a key that is as good as random, the same in any run and engine: MD5 of seed and key as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


#: Hexadecimal digits of the draw that say in which bucket of a stratum a group is summed: 4,096 buckets.
BUCKET_DIGITS = 3


def _takes(held: Column, n: Column, target: Column) -> Column:
    """Whether n tasks more bring what is held nearer to the target."""
    return F.abs(held + n - target) < F.abs(held - target)


def _fill(free: DataFrame, state: DataFrame) -> DataFrame:
    """The rounds of a greedy fill: (stratum, from, to, held, target), from each of which groups after `from` and before `to` are taken if they are wanted at its start.

    free: stratum, at (what orders the groups), bucket, n. state: stratum, target, held. What is held only
    grows, so a group that is not wanted when a round begins never will be, and is left out. Of the others
    the longest prefix is taken in which each is still wanted after those before it: prefix sums
    over buckets, then inside each. The next round begins behind the group that ended it. As that group was
    wanted before and no longer is, what is missing has become at most half of its size; rounds are few.
    """
    same = lambda left, right: left["stratum"].eqNullSafe(right["stratum"])
    none = F.lit(None).cast(free.schema["at"].dataType)
    active, rounds = state.withColumn("from", none), []
    while True:
        now = active.select(F.col("stratum").alias("s"), "from", "held", "target")
        wanted = free.join(now, F.col("stratum").eqNullSafe(F.col("s"))).where((F.col("from").isNull() | (F.col("at") > F.col("from"))) & _takes(F.col("held"), F.col("n"), F.col("target"))).select("stratum", "at", "bucket", "n", "held", "target")
        before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy("stratum", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = wanted.groupBy("stratum", "bucket").agg(F.sum("n").alias("n"))
        starts = sums.select(F.col("stratum").alias("s"), F.col("bucket").alias("b"), before("bucket").alias("start"))
        inside = wanted.withColumn("inside", before("at", "bucket")).join(starts, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        running = F.col("held") + F.col("start") + F.col("inside")
        ends = inside.where(~_takes(running, F.col("n"), F.col("target"))).groupBy("stratum").agg(F.min(F.struct("at", running.alias("held"))).alias("end"))
        found = active.alias("a").join(ends.alias("e"), same(active, ends), "left").select("a.*", F.col("end.at").alias("to"), F.col("end.held").alias("then"))
        found = sinks.settled(found, "round")
        rounds.append(found)
        active = found.where("to is not null").select("stratum", "target", F.col("then").alias("held"), F.col("to").alias("from"))
        if active.isEmpty():
            return reduce(DataFrame.unionByName, rounds).select("stratum", "from", "to", "held", "target")


def assigned(tasks: DataFrame, stratum: str, group: str, fraction: float, seed: int = 0, pinned: DataFrame | None = None) -> DataFrame:
    """(stratum, group, n_tasks, pinned, side): pinned groups go public, then others in drawn order while that brings the stratum's share of tasks nearer to the fraction.

    A group that would overshoot is skipped and the next one tried. The fold that this says is done in
    rounds over all groups at once, none of which brings a stratum together.
    """
    sizes = tasks.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("n_tasks"))
    if pinned is None:
        sizes = sizes.withColumn("pinned", F.lit(False))
    else:
        sizes = sizes.join(pinned.select(group).distinct().withColumn("pinned", F.lit(True)), group, "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    sizes = sinks.settled(sizes.select(stratum, group, "n_tasks", "pinned", F.struct(draw(seed, F.col(group)).alias("h"), F.col(group).alias("g")).alias("__at")), "split")
    free = sizes.where("not pinned").select(F.col(stratum).alias("stratum"), F.col("__at").alias("at"), F.substring("__at.h", 1, BUCKET_DIGITS).alias("bucket"), F.col("n_tasks").alias("n"))
    state = sizes.groupBy(F.col(stratum).alias("stratum")).agg((F.lit(fraction) * F.sum("n_tasks")).alias("target"), F.coalesce(F.sum(F.when(F.col("pinned"), F.col("n_tasks"))), F.lit(0)).alias("held"))
    rounds = _fill(free, state).select(F.col("stratum").alias("__s"), "from", "to", "held", "target")
    at = F.col("__at")
    mine = F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("from").isNull() | (at > F.col("from"))) & (F.col("to").isNull() | (at <= F.col("to")))
    taken = (F.col("to").isNull() | (at < F.col("to"))) & _takes(F.col("held"), F.col("n_tasks"), F.col("target"))
    side = F.when(F.col("pinned") | taken, F.lit("public")).otherwise(F.lit("private"))
    return sizes.join(rounds, mine).select(stratum, group, "n_tasks", "pinned", side.alias("side"))


def orchestrated(tasks: DataFrame, stratum: str, group: str, task: str, published: Sequence[str], fraction: float, seed: int, verified: DataFrame) -> DataFrame:
    """tasks of the published strata with split (disjoint), is_verified (public tasks of verified groups) and is_hidden_view (private tasks, which are shown again without answers). Verified groups are pinned; one without any task stops the job."""
    kept = tasks.where(F.col(stratum).isin(*published))
    sides = assigned(kept, stratum, group, fraction, seed, verified)
    known = verified.select(group).distinct()
    lost = known.join(kept.select(group).distinct(), group, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    stop = F.raise_error(F.concat(lost.cast("string"), F.lit(" verified groups have no task"))).cast("boolean")
    rows = kept.join(sides.select(stratum, group, "pinned", F.col("side").alias("split")), [stratum, group])
    rows = rows.where(F.when(lost > 0, stop).otherwise(F.lit(True)))
    return rows.select(stratum, group, task, "split", (F.col("pinned") & (F.col("split") == "public")).alias("is_verified"), (F.col("split") == "private").alias("is_hidden_view"))


def complete(tasks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Tasks whose key is wanted; a wanted key that no task has stops the job."""
    lost = wanted.join(tasks, key, "left_anti").agg(F.min(key)).scalar()
    stop = F.raise_error(F.concat(F.lit("not built: "), lost.cast("string"))).cast("boolean")
    return tasks.join(wanted.select(key), key, "left_semi").where(F.when(lost.isNotNull(), stop).otherwise(F.lit(True)))
