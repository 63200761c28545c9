"""Group statistics: mean and standard error in its several definitions.

All are algebraic: one shuffle on the grouping keys with map-side partial aggregation, two
where a level of tasks lies between the rows and the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_sem(x: Column) -> tuple[Column, Column, Column]:
    """(n, mean, standard error) of the values that are not null; the error of a single value is null."""
    n = F.count(x)
    return n, F.avg(x), F.stddev_samp(x) / F.sqrt(n)


def zero_filled(mean: Column, sem: Column) -> tuple[Column, Column]:
    """Empty groups count as (0, 0), single values have no error."""
    zero = F.lit(0.0)
    return F.coalesce(mean, zero), F.coalesce(sem, zero)


def checked_reward(x: Column) -> Column:
    """x as a reward: null stays null (a trial without a verdict), a number outside 0 to 1 stops the job."""
    stop = F.raise_error(F.concat(F.lit("reward outside [0, 1]: "), x.cast("string"))).cast("double")
    return F.when(x.isNull() | x.between(0, 1), x.cast("double")).otherwise(stop)


def graded_accuracy(rows: DataFrame, group: Sequence[str], task: Sequence[str], value: str) -> DataFrame:
    """Mean value over all trials of a group that have one, and its standard error.

    Trials without a value are left out, and so are tasks of which no trial has one. Where any
    task of the group has two or more trials, the error comes from the variance within tasks,
    sum(var / k) / n^2; otherwise from the variance between tasks, var / n. A group with one
    task of one trial has error 0.
    """
    per_task = rows.where(F.col(value).isNotNull()).groupBy(*group, *task).agg(
        F.sum(value).alias("total"),
        F.count(value).alias("k"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("task_var"),
    )
    n = F.count(F.lit(1))
    within = F.sum(F.col("task_var") / F.col("k")) / (n * n)
    between = F.coalesce(F.var_samp(F.col("total") / F.col("k")), F.lit(0.0)) / n
    return per_task.groupBy(*group).agg(
        n.alias("n_tasks"),
        F.sum("k").alias("n_trials"),
        (F.sum("total") / F.sum("k")).alias("mean"),
        F.sqrt(F.when(F.max("k") >= 2, within).otherwise(between)).alias("se"),
    )


def padded_mean_sem(total: Column, squares: Column, n: Column) -> tuple[Column, Column]:
    """(mean, standard error) of a sample filled up with zeros to n values, from its sum and sum of squares."""
    mean = total / n
    spread = F.greatest(squares - n * mean * mean, F.lit(0.0))
    return mean, F.when(n > 1, F.sqrt(spread / (n - 1)) / F.sqrt(n)).otherwise(F.lit(0.0))


def in_quadrature(*errors: Column) -> Column:
    """The error of a sum of independent terms."""
    total = F.lit(0.0)
    for e in errors:
        total = total + e * e
    return F.sqrt(total)


def ranked(rows: DataFrame, by: str, ties: Sequence[str] = (), parts: int = 1024) -> DataFrame:
    """rows with their rank by a number, highest first; equal numbers share a rank, nulls come last.

    Values are dealt to `parts` equal slices between the least and the largest. A rank is one
    plus what the higher slices hold (a running sum over one row per slice) plus what the own
    slice holds above the value.
    """
    lo, hi = (rows.select(f(F.col(by).cast("double"))).scalar() for f in (F.min, F.max))
    share = F.try_divide(F.col(by) - lo, hi - lo)
    part = F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(parts - 1))).cast("int")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", part)
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("__p").agg(F.sum("__n").alias("__n")).select("__p", before(Window.orderBy(F.desc("__p"))).alias("__above"))
    inside = before(Window.partitionBy("__p").orderBy(F.col(by).desc_nulls_last()))
    places = counts.withColumn("__in", inside).join(sums, "__p").select(F.col(by).alias("__v"), (F.col("__above") + F.col("__in") + 1).cast("int").alias("rank"))
    return rows.join(places, rows[by].eqNullSafe(places["__v"])).drop("__v").orderBy("rank", *ties)


def padded_by_group(records: DataFrame, group: Sequence[str], trial: str, measures: dict[str, Column], trials: DataFrame | None = None) -> DataFrame:
    """Mean and standard error of each measure per group (name and name_sem), over as many trials as there were, those without a record counting as zeros; n_records, n_trials.

    trials: group columns and n_trials, counted elsewhere; a group it lacks has as many trials as records. Without it, the
    distinct trials of the records count. Null measures count as zeros.
    """
    sums = []
    for name, x in measures.items():
        x = F.coalesce(x.cast("double"), F.lit(0.0))
        sums += [F.sum(x).alias(f"__s_{name}"), F.sum(x * x).alias(f"__q_{name}")]
    found = records.groupBy(*group).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(trial).alias("__own"), *sums)
    if trials is None:
        found = found.withColumn("n_trials", F.col("__own"))
    else:
        told = trials.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("n_trials").alias("__told"))
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        found = found.join(told, on, "left").withColumn("n_trials", F.coalesce("__told", "n_records"))
    out = []
    for name in measures:
        mean, sem = padded_mean_sem(F.col(f"__s_{name}"), F.col(f"__q_{name}"), F.col("n_trials"))
        out += [mean.alias(name), sem.alias(f"{name}_sem")]
    return found.select(*group, "n_records", "n_trials", *out)
