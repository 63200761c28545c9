"""Streaming counterparts of the telemetry operators, on Structured Streaming.

Each takes a streaming DataFrame with event time `ts` (TIMESTAMP) and returns a streaming one
for append mode: a row leaves once the watermark has passed what it depends on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from quern.sources import sinks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling(events: DataFrame, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def first_seen(events: DataFrame, body: str, late: str = "1 hour") -> DataFrame:
    """The first event of each body within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([body])


#: Milliseconds of event time whose waiting rows lie together in state.
BUCKET_MS = 3_600_000


def _ms(ts: object) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class Ordered(StatefulProcessor):
    """Rows of a key in order of event time, whatever order they arrive in: they wait in state until the watermark has passed them.

    Every access to state is a call out of Python, so a key's rows are added to one list in one call, and the list
    is read when the watermark reaches its first row. What is left then waits on in the list if it is
    short, else in buckets of event time, of which a batch reads and writes those that the watermark
    has reached. Subclasses keep what they know of a key in one row of state and fold rows into it.
    """

    #: Columns of a waiting row after its time and id, the state, and the columns given out.
    WAITING, STATE, OUT = "", "", ()
    #: Rows that wait as one list before they are dealt to buckets.
    MOST_LISTED = 2_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = f"ts timestamp, event_id long, {self.WAITING}"
        self.listed = handle.getListState("listed", row)
        self.waiting = handle.getMapState("waiting", "bucket long", f"rows array<struct<ts:timestamp,event_id:long,{self.WAITING.replace(' ', ':').replace(',:', ',')}>>")
        #: The first time in the list and whether any bucket is held, in milliseconds.
        self.places = handle.getValueState("places", "first long, buckets boolean")
        self.known = handle.getValueState("known", self.STATE)

    def fold(self, known: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """(state after a row, what it gives out)."""
        raise NotImplementedError

    def _held(self, bucket: int) -> list[tuple]:
        return [tuple(r) for r in self.waiting.getValue((bucket,))[0]] if self.waiting.containsKey((bucket,)) else []

    def _deal(self, rows: list[tuple]) -> None:
        buckets: dict[int, list[tuple]] = {}
        for row in rows:
            buckets.setdefault(_ms(row[0]) // BUCKET_MS, []).append(row)
        for bucket, new in buckets.items():
            self.waiting.updateValue((bucket,), (self._held(bucket) + new,))

    def _reached(self, until_ms: int) -> tuple[list[tuple], int | None]:
        """(rows of buckets that the watermark has passed, the first time that stays in one)."""
        out = []
        for bucket in sorted(int(b) for (b,) in self.waiting.keys()):
            rows = sorted(self._held(bucket), key=lambda r: (r[0], r[1])) if bucket * BUCKET_MS <= until_ms else []
            ready = [r for r in rows if _ms(r[0]) <= until_ms]
            rest = rows[len(ready) :]
            out += ready
            if ready and rest:
                self.waiting.updateValue((bucket,), (rest,))
            elif ready:
                self.waiting.removeKey((bucket,))
            if rest or not rows:
                return out, _ms(rest[0][0]) if rest else bucket * BUCKET_MS
        return out, None

    def _advance(self, key: tuple, new: list[tuple], until_ms: int) -> Iterator[pd.DataFrame]:
        first, dealt = self.places.get() or (None, False)
        least = min((_ms(r[0]) for r in new), default=None)
        out, before = [], (first, dealt)
        if min((x for x in (first, least) if x is not None), default=until_ms + 1) > until_ms and not dealt:
            # Nothing is ready: the new rows join the others unread.
            if new:
                self.listed.appendList(new)
                first = least if first is None else min(first, least)
        else:
            rows = [*new, *(tuple(r) for r in self.listed.get())] if first is not None else list(new)
            had, first = first is not None, None
            ready = [r for r in rows if _ms(r[0]) <= until_ms]
            rest = [r for r in rows if _ms(r[0]) > until_ms]
            bucket = None
            if len(rest) > self.MOST_LISTED:
                self._deal(rest)
                rest, dealt = [], True
            if dealt:
                passed, bucket = self._reached(until_ms)
                ready += passed
                dealt = bucket is not None
            if rest:
                self.listed.put(rest)
                first = min(_ms(r[0]) for r in rest)
            elif had:
                self.listed.clear()
            if ready:
                known = self.known.get()
                had = known is not None
                for row in sorted(ready, key=lambda r: (r[0], r[1])):
                    known, found = self.fold(known, row)
                    if found is not None:
                        out.append((*key, *found))
                if known is not None:
                    self.known.update(known)
                elif had:
                    self.known.clear()
            if bucket is not None:
                self.handle.registerTimer(max(bucket, until_ms) + 1)
        if first is not None and first != before[0]:
            self.handle.registerTimer(first + 1)
        if first is None and not dealt:
            if before != (None, False):
                self.places.clear()
        elif (first, dealt) != before:
            self.places.update((first, dealt))
        if out:
            yield pd.DataFrame(out, columns=["user_id", *self.OUT])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = ["ts", "event_id", *[c.split()[0] for c in self.WAITING.split(", ")]]
        yield from self._advance(key, [tuple(r) for part in rows for r in part[names].itertuples(index=False)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Toggle(Ordered):
    """On-intervals of a switch: the state is the time it went on, if it is on."""

    WAITING, STATE, OUT = "is_off boolean", "at timestamp", ("on_ts", "off_ts")

    def fold(self, known: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        ts, _, is_off = row
        if is_off:
            return None, ((known[0], ts) if known is not None else None)
        return (known if known is not None else (ts,)), None


class Onset(Ordered):
    """The first sample after a key's incident above mean and three deviations of those before it; the state is count, mean, squares, whether the incident has come and whether the onset has."""

    WAITING, STATE, OUT = "value double, incident boolean", "n long, mean double, squares double, hit boolean, done boolean", ("onset",)

    def fold(self, known: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        ts, _, x, incident = row
        n, mean, squares, hit, done = known or (0, 0.0, 0.0, False, False)
        hit = hit or bool(incident)
        if not hit:
            n, shift = n + 1, x - mean
            mean += shift / n
            squares += shift * (x - mean)
            return (n, mean, squares, hit, done), None
        spread = (squares / (n - 1)) ** 0.5 if n > 1 else 0.0
        # With nothing or only zeros before, any sample that is not zero is the onset.
        above = x > mean + 3 * spread if n and (mean or squares) else x != 0
        return (n, mean, squares, hit, done or above), ((ts,) if above and not done else None)


def toggles(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed on-intervals (user_id, on_ts, off_ts) of columns user_id, ts, event_id, is_off. Needs the RocksDB state store."""
    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.transformWithStateInPandas(Toggle(), "user_id long, on_ts timestamp, off_ts timestamp", "Append", "EventTime")


def onsets(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, onset) of columns user_id, ts, event_id, value, incident. Needs the RocksDB state store."""
    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.transformWithStateInPandas(Onset(), "user_id long, onset timestamp", "Append", "EventTime")


def with_rocks(spark: SparkSession) -> None:
    """Sets the state store that keyed processors need, for this session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def drained(stream: DataFrame, tag: str = "drained") -> DataFrame:
    """Runs a stream in append mode over all that is there, into a Parquet table in the shared folder, and returns that. A run that is broken off goes on from its checkpoint."""
    root = sinks.workspace(stream.sparkSession, tag)
    q = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def late_rows(events: DataFrame, late: str = "1 hour", passed: Column | None = None, tag: str = "late") -> DataFrame:
    """The rows of a stream that a watermark of `late` drops, with the number of their batch: those for which it had passed `passed` (their time; for windows the window's end) when the batch before theirs began. State that a mark closes is given up at the end of a batch, so rows are judged by the mark of the batch before.

    Spark counts such rows and keeps none. This reads the stream once more, by itself, keeps the latest
    time of each batch as a small table in the shared folder, and appends what is behind the mark. A batch that is run again replaces what it wrote.
    """
    spark, root = events.sparkSession, sinks.workspace(events.sparkSession, tag)
    end = F.col("ts") if passed is None else passed
    out = StructType([*events.schema.fields, StructField("batch", LongType())])

    def each(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        top = None
        if batch > 1:
            top = session.read.schema("top timestamp, batch long").parquet(f"{root}/marks").where(F.col("batch") < batch - 1).agg(F.max("top")).first()[0]
        behind = rows.where(F.lit(False)) if top is None else rows.where(end <= F.date_trunc("millisecond", F.lit(top)) - F.expr(f"INTERVAL {late}"))
        behind.write.mode("overwrite").parquet(f"{root}/late/batch={batch}")
        rows.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{root}/marks/batch={batch}")

    q = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out).parquet(f"{root}/late")
