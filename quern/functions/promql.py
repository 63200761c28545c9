"""A small part of PromQL: reading selectors, and rates and aggregations over samples."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.timeline import micros

def metric_name(query: Column) -> Column:
    """The metric a query selects: calls peeled from outside, however deep, each with what follows its last parenthesis; ranges and matchers dropped. Of a text that doesn't begin with a call, what is left of the whole."""
    calls = F.regexp_extract_all(F.regexp_extract(query, r"^((?:\w+\()*)", 1), F.lit(r"\w+\("), F.lit(0))
    inner = F.aggregate(F.transform(calls, lambda _: F.lit(0)), query, lambda x, _: F.regexp_replace(x, r"(?s)^\w+\((.+)\)[^)]*$", "$1"))
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"\[\d+[smhd](?:\d+[smhd])*\]", ""), r"\{[^}]*\}", ""))


#: One matcher of a selector: a name, any of the four comparisons, a double-quoted value.
MATCHER = r'(\w+)\s*[=!~]+\s*"([^"]*)"'


def labels_of(query: Column) -> Column:
    """The matchers of a query's first selector as sorted (key, value) pairs, the last of a repeated key."""
    inside = F.regexp_extract(query, r"\{([^}]*)\}", 1)
    key, value = (F.regexp_extract_all(inside, F.lit(MATCHER), F.lit(g)) for g in (1, 2))
    pairs = F.arrays_zip(key.alias("key"), value.alias("value"))
    last = F.filter(pairs, lambda p, k: ~F.array_contains(F.slice(key, k + 2, F.greatest(F.size(key) - k - 1, F.lit(0))), p["key"]))
    return F.array_sort(last)


def label_text(query: Column) -> Column:
    """Sorted matchers as k=v joined by commas: a grouping key."""
    return F.array_join(F.transform(labels_of(query), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")


#: Microseconds of a bucket of a series: 18 minutes. A series of any length is worked on bucket by bucket.
SPAN = 1 << 30


def rises(samples: DataFrame, series: Sequence[str], ts: str, value: str, tie: str | None = None, out: str = "rise") -> DataFrame:
    """samples with how much each is above its predecessor in its series: a value below it counts whole (the counter was reset), the first counts nothing.

    Predecessors are found inside buckets of time; the first of a bucket takes the last of the bucket before,
    of which there is one row per bucket.
    """
    order = [ts, *([tie] if tie else [])]
    rows = samples.withColumn("__b", F.floor(micros(F.col(ts)) / SPAN).cast("long"))
    w = Window.partitionBy(*series, "__b").orderBy(*order)
    lasts = rows.groupBy(*series, "__b").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    before = lasts.select(*[F.col(c).alias(f"__{c}") for c in series], F.col("__b").alias("__at"), F.lag("__last").over(Window.partitionBy(*series).orderBy("__b")).alias("__before"))
    on = F.col("__b") == F.col("__at")
    for c in series:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = rows.withColumn("__own", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).join(before, on)
    last = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__own"))
    rise = F.when(last.isNull(), F.lit(0.0)).when(F.col(value) < last, F.col(value)).otherwise(F.col(value) - last)
    return placed.select(*samples.columns, rise.alias(out))


def rate(samples: DataFrame, series: Sequence[str], ts: str, value: str, seconds: int, out: str = "rate", tie: str | None = None) -> DataFrame:
    """samples with the per-second increase over the last `seconds`, corrected for counter resets (a value below its predecessor counts whole).

    The frame looks into its own bucket of time and, by copies of what lies within `seconds` of the next
    bucket, into the one before.
    """
    back = seconds * 1_000_000
    width = max(SPAN, back)
    us = micros(F.col(ts))
    bucket = F.floor(us / width).cast("long")
    near = F.when(us > (bucket + 1) * width - back, F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))
    places = F.array_compact(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), near))
    rows = rises(samples, series, ts, value, tie, "__rise").withColumn("__us", us).withColumn("__p", F.explode(places))
    rows = rows.withColumn("__b", F.col("__p.b")).withColumn("__own", F.col("__p.own"))
    w = Window.partitionBy(*series, "__b").orderBy("__us").rangeBetween(-back + 1, 0)
    return rows.withColumn(out, F.sum("__rise").over(w) / F.lit(float(seconds))).where("__own").drop("__rise", "__us", "__p", "__b", "__own")


def on_grid(samples: DataFrame, series: Sequence[str], ts: str, value: str, step_seconds: int) -> DataFrame:
    """Each series at every step from its first to its last sample: (series, step, value), the value of the last sample at or before the step, one per step."""
    size = step_seconds * 1_000_000
    us = micros(F.col(ts))
    # A sample holds from the first step not before it up to the last before the next sample's first step.
    first = F.ceil(us / size).cast("long")
    rows = samples.withColumn("__s", first).withColumn("__us", us)
    last = rows.groupBy(*series, "__s").agg(F.max_by(value, F.struct("__us", value)).alias(value))
    w = Window.partitionBy(*series).orderBy("__s")
    upto = F.coalesce(F.lead("__s").over(w) - 1, F.col("__s"))
    held = last.withColumn("__z", upto).withColumn("__k", F.explode(F.sequence("__s", "__z")))
    return held.select(*series, F.timestamp_micros(F.col("__k") * size).cast("timestamp_ntz").alias("step"), value)


# Evaluation of query texts over samples (name, labels, ts, value); labels are sorted (key, value) pairs.

_TOKEN = re.compile(r"""\s*(?:(?P<word>[a-zA-Z_:][a-zA-Z0-9_:]*)|(?P<string>"[^"]*"|'[^']*')|(?P<range>\[\d+[smhd]\])|(?P<op>=~|!~|!=|[={}(),/*+-])|(?P<bad>\S))""")
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}
_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double")}
_RATES = {"rate", "increase"}
_OPERATORS = {"/": F.try_divide, "*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b}


@dataclass(frozen=True)
class Selector:
    """name{matchers}[seconds]; seconds is None for an instant vector."""

    name: str | None
    matchers: tuple[tuple[str, str, str], ...] = ()
    seconds: int | None = None


@dataclass(frozen=True)
class Rate:
    function: str
    of: Selector


@dataclass(frozen=True)
class Aggregate:
    """kind: by or without."""

    function: str
    of: object
    kind: str = "by"
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    operator: str
    left: object
    right: object


class _Reader:
    def __init__(self, body: str) -> None:
        self.body, self.tokens, self.at = body, [(m.lastgroup, m.group(m.lastgroup)) for m in _TOKEN.finditer(body) if m.lastgroup], 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None, kind: str | None = None) -> str:
        if self.at == len(self.tokens) or (wanted and self.peek() != wanted) or (kind and self.tokens[self.at][0] != kind):
            raise ValueError(f"can't read {self.body!r} at {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def names(self) -> tuple[str, ...]:
        found = []
        self.take("(")
        while self.peek() != ")":
            found.append(self.take(kind="word"))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return tuple(found)

    def expression(self) -> object:
        out = self.term()
        while self.peek() in _OPERATORS:
            out = Binary(self.take(), out, self.term())
        return out

    def term(self) -> object:
        word = self.peek()
        if word == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        after = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else None
        if word in _AGGREGATES and after in ("(", "by", "without"):
            self.take()
            kind, labels = (self.take(), self.names()) if after != "(" else ("by", ())
            self.take("(")
            of = self.expression()
            self.take(")")
            if self.peek() in ("by", "without"):
                kind, labels = self.take(), self.names()
            return Aggregate(word, of, kind, labels)
        if word in _RATES and after == "(":
            self.take(), self.take()
            of = self.selector()
            self.take(")")
            if of.seconds is None:
                raise ValueError(f"{word} needs a range in {self.body!r}")
            return Rate(word, of)
        return self.selector()

    def selector(self) -> Selector:
        name = self.take(kind="word") if self.peek() != "{" else None
        matchers = []
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                key, op = self.take(kind="word"), self.take(kind="op")
                matchers.append((key, op, self.take(kind="string")[1:-1]))
                if self.peek() == ",":
                    self.take()
            self.take("}")
        size = self.take()[1:-1] if self.peek() and self.tokens[self.at][0] == "range" else None
        return Selector(name, tuple(matchers), int(size[:-1]) * _SECONDS[size[-1]] if size else None)


def parsed(query: str) -> object:
    """The tree of a query: selectors with any matchers, rate and increase, aggregates by or without labels, arithmetic of vectors."""
    reader = _Reader(query)
    out = reader.expression()
    if reader.peek() is not None:
        raise ValueError(f"can't read {query!r} at {reader.peek()!r}")
    return out


def _value(key: str) -> Column:
    """A label's value, empty where a series lacks it."""
    return F.coalesce(F.filter("labels", lambda p: p["key"] == key)[0]["value"], F.lit(""))


def _selected(samples: DataFrame, s: Selector) -> DataFrame:
    rows = samples if s.name is None else samples.where(F.col("name") == s.name)
    for key, op, value in s.matchers:
        own = F.col("name") if key == "__name__" else _value(key)
        hit = own.rlike(f"^(?:{value})$") if "~" in op else own == value
        rows = rows.where(~hit if op[0] == "!" else hit)
    return rows


def _spread(rows: DataFrame, seconds: int, step: int, stop: int) -> DataFrame:
    """rows at every step that looks back on them: those from their time on, up to `seconds` later, none after `stop`. At most seconds / step rows for one."""
    us, size = micros(F.col("ts")), step * 1_000_000
    first = F.ceil(us / size).cast("long")
    last = F.least((F.ceil((us + seconds * 1_000_000) / size) - 1).cast("long"), F.lit(stop // step))
    return rows.where(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))


def evaluate(samples: DataFrame, query: str, step: int, stop: int, lookback: int = 300) -> DataFrame:
    """(labels, step, value) of a query at all multiples of `step` seconds up to `stop` (epoch seconds).

    An instant vector takes the last sample of the last `lookback` seconds, a rate what the series
    rose by inside its range, corrected for resets, over the range's seconds.
    """

    def run(node: object) -> DataFrame:
        if isinstance(node, Selector):
            rows = _spread(_selected(samples, node), lookback, step, stop)
            return rows.groupBy("name", "labels", "__k").agg(F.max_by("value", F.struct("ts", "value")).alias("value")).select("labels", "__k", "value")
        if isinstance(node, Rate):
            risen = rises(_selected(samples, node.of), ["name", "labels"], "ts", "value", "value")
            rows = _spread(risen, node.of.seconds, step, stop)
            over = float(node.of.seconds) if node.function == "rate" else 1.0
            return rows.groupBy("name", "labels", "__k").agg((F.sum("rise") / F.lit(over)).alias("value")).select("labels", "__k", "value")
        if isinstance(node, Aggregate):
            keep = (lambda p: p["key"].isin(*node.labels)) if node.kind == "by" else (lambda p: ~p["key"].isin(*node.labels))
            rows = run(node.of)
            if not node.labels:
                kept = F.col("labels") if node.kind == "without" else F.filter("labels", lambda p: F.lit(False))
            else:
                kept = F.filter("labels", keep)
            return rows.groupBy(kept.alias("labels"), "__k").agg(_AGGREGATES[node.function]("value").alias("value"))
        left, right = run(node.left), run(node.right).withColumnRenamed("value", "__other")
        return left.join(right, ["labels", "__k"]).select("labels", "__k", _OPERATORS[node.operator](F.col("value"), F.col("__other")).alias("value"))

    found = run(parsed(query))
    return found.select("labels", F.timestamp_micros(F.col("__k") * (step * 1_000_000)).cast("timestamp_ntz").alias("step"), "value")
