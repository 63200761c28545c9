"""Analytics of agent trajectories: sequences of categorised steps per trial."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(steps: DataFrame, trial: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """steps numbered from 1 in each trial."""
    return steps.withColumn(name, F.row_number().over(Window.partitionBy(*trial).orderBy(*order)))


def transitions(steps: DataFrame, trial: Sequence[str], step: str, category: str) -> DataFrame:
    """(prev, next, weight): moves from the categories of a step to those of the next step of the trial, each move weighing one over the number of pairs.

    steps holds a row per trial, step and category. Steps are numbered densely, then joined
    with their successors on (trial, number): both sides are partitioned alike.
    """
    w = Window.partitionBy(*trial).orderBy(step)
    dense = steps.select(*trial, F.col(category).alias("cat"), F.dense_rank().over(w).alias("n"))
    sized = dense.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*trial, "n")))
    left = sized.select(*trial, F.col("n"), F.col("cat").alias("prev"), F.col("k").alias("kp"))
    right = sized.select(*trial, (F.col("n") - 1).alias("n"), F.col("cat").alias("next"), F.col("k").alias("kn"))
    return left.join(right, [*trial, "n"]).groupBy("prev", "next").agg(F.sum(F.lit(1.0) / (F.col("kp") * F.col("kn"))).alias("weight"))


def normalised(moves: DataFrame) -> DataFrame:
    """moves with p: the share of weight among all moves from the same category (0 where there is none)."""
    total = F.sum("weight").over(Window.partitionBy("prev"))
    return moves.withColumn("p", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)))


def collapsed(steps: DataFrame, trial: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Runs of equal labels as their first row."""
    w = Window.partitionBy(*trial).orderBy(*order)
    return steps.withColumn("__p", F.lag(label).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col("__p").eqNullSafe(F.col(label))).drop("__p", "__n")


def quarter(pos: Column, n: Column) -> Column:
    """The quarter (0 to 3) of step pos of n, from 1; bounds are the integer parts of q n / 4, which puts remainders elsewhere than ntile does."""
    at = pos - 1
    return sum((at >= F.floor(F.lit(q) * n / 4)).cast("int") for q in (1, 2, 3))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """rows with the number, from 1, of the batch of `size` that each falls in."""
    placed = numbered(rows, keys, order, "__at")
    return placed.withColumn(name, F.ceil(F.col("__at") / size).cast("int")).drop("__at")


#: Of a command's first line, this many characters must stand in an input.
NEEDLE = 30


class Places:
    """Where needles stand in a list of texts: one pass of an Aho-Corasick automaton over each text, then a sorted list per needle to bisect in."""

    def __init__(self, needles: Sequence[str], texts: Sequence[str | None]) -> None:
        import ahocorasick

        words = ahocorasick.Automaton()
        self._held: dict[str, list[int]] = {n: [] for n in needles if n}
        for n in self._held:
            words.add_word(n, n)
        if not self._held:
            return
        words.make_automaton()
        for k, body in enumerate(texts):
            for n in {n for _, n in words.iter(body or "")}:
                self._held[n].append(k)

    def first(self, needle: str, start: int) -> int | None:
        """The first text from `start` on that holds a needle."""
        held = self._held.get(needle, [])
        at = bisect_left(held, start)
        return held[at] if at < len(held) else None


def aligned(calls: DataFrame, inputs: DataFrame, trial: str, call: str, command: str, at: str, data: str, carry_calls: Sequence[str] = (), carry_inputs: Sequence[str] = ()) -> DataFrame:
    """calls with place: the first input, of those after the one taken last, that holds the start of the command's first line; null where the line is blank or none holds it.

    Greedy matching in order is no relational join: one trial's calls and inputs are walked
    together, in time that grows with their length. Places count a trial's inputs from 0 in the order of `at`.
    carry_calls, carry_inputs: columns that come along from the call and from the input it is placed at.
    """
    import pyarrow as pa

    out = calls.select(trial, call).withColumn("place", F.lit(None).cast("long")).select(trial, call, "place").schema
    for column in [*(calls.schema[c] for c in carry_calls), *(inputs.schema[c] for c in carry_inputs)]:
        out = out.add(column.name, column.dataType, True)

    def walk(own: pa.Table, seen: pa.Table) -> pa.Table:
        in_order = lambda t, key: t.take(sorted(range(t.num_rows), key=t.column(key).to_pylist().__getitem__))
        own, seen = in_order(own, call), in_order(seen, at)
        needles = [(c or "").split("\n", 1)[0].strip()[:NEEDLE] for c in own.column(command).to_pylist()]
        where, free, places = Places(needles, seen.column(data).to_pylist()), 0, []
        for needle in needles:
            hit = where.first(needle, free)
            free = free if hit is None else hit + 1
            places.append(hit)
        at_place = pa.array(places, pa.int64())
        return pa.table([own.column(trial), own.column(call), at_place, *[own.column(c) for c in carry_calls], *[seen.column(c).take(at_place) for c in carry_inputs]], names=out.names)

    left = calls.select(trial, call, command, *carry_calls).groupBy(trial)
    return left.cogroup(inputs.select(trial, at, data, *carry_inputs).groupBy(trial)).applyInArrow(walk, out)
