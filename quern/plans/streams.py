"""Windowed counts as batch queries, and the same by Structured Streaming over the events folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.registry import Tables, query
from quern.plans.timelines import _INTERVALS
from quern.sources import sinks
from quern.streaming import operators as live

_TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLIDING = "SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"
_SESSION = """
    WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k
"""


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in rows.dtypes])


@query(_TUMBLING)
def tumbling_counts(t: Tables) -> DataFrame:
    rows = _timed(t.events).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _plain(rows.select(F.col("window.start").alias("start"), "event_type", "n"))


@query(_SLIDING)
def sliding_counts(t: Tables) -> DataFrame:
    rows = _timed(t.events).groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _plain(rows.select(F.col("window.start").alias("start"), "event_type", "n"))


@query(_SESSION)
def session_counts(t: Tables) -> DataFrame:
    rows = _timed(t.events).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return _plain(rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n"))


def _stream(t: Tables) -> DataFrame:
    """The events table as a stream, be it a file or a folder of files: a pattern is matched by either, a plain path must be a folder."""
    return _timed(t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]"))


# Append mode gives out what the watermark, an hour behind the last event, has passed.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT * FROM ({_TUMBLING}) WHERE start + INTERVAL 1 HOUR <= {_MARK}")
def stream_tumbling(t: Tables) -> DataFrame:
    return _plain(live.drained(live.tumbling(_stream(t), "1 hour", ["event_type"])))


@query(f"SELECT * FROM ({_SLIDING}) WHERE start + INTERVAL 2 HOUR <= {_MARK}")
def stream_sliding(t: Tables) -> DataFrame:
    return _plain(live.drained(live.sliding(_stream(t), "2 hours", "1 hour", ["event_type"])))


@query(f"WITH r AS ({_SESSION}) SELECT * FROM r WHERE stop <= {_MARK}")
def stream_sessions(t: Tables) -> DataFrame:
    return _plain(live.drained(live.sessions(_stream(t), "30 minutes", "user_id")))


# Events arrive in batches by spans of five days; one in forty comes two batches late.
_LATE = "event_id % 40 = 7"
_ARRIVED = f"""
    e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 + CASE WHEN {_LATE} THEN 2 ELSE 0 END AS file FROM events),
    b AS (SELECT *, dense_rank() OVER (ORDER BY file) - 1 AS batch FROM e),
    tops AS (SELECT batch, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 1 HOUR AS mark FROM b GROUP BY batch),
    a AS (SELECT b.*, mark, date_trunc('hour', ts) AS hour FROM b JOIN tops USING (batch))
"""


def _arriving(t: Tables) -> DataFrame:
    """The events as a stream of files, one to a batch, in the order in which they were written."""
    root = sinks.workspace(t.spark, "arriving")
    late = F.when(F.expr(_LATE), 2).otherwise(0)
    rows = t.events.withColumn("file", F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5) + late)
    held = sinks.settled(rows, "by-file")
    for (file,) in held.select("file").distinct().orderBy("file").collect():  # a file is a batch: some seven in all
        held.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/f{int(file):04d}")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")
    return _timed(stream)


@query(f"WITH {_ARRIVED} SELECT event_id, CAST(batch AS BIGINT) AS batch FROM a WHERE mark IS NOT NULL AND hour + INTERVAL 1 HOUR <= mark")
def stream_late_rows(t: Tables) -> DataFrame:
    """Events that come after the watermark has closed their hour, with the batch they came in."""
    return live.late_rows(_arriving(t), "1 hour", F.window("ts", "1 hour")["end"]).select("event_id", "batch")


@query(f"""
    WITH {_ARRIVED} SELECT hour AS start, event_type, count(*) AS n FROM a WHERE mark IS NULL OR hour + INTERVAL 1 HOUR > mark GROUP BY ALL
    HAVING hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
""")
def stream_counts_without_late(t: Tables) -> DataFrame:
    """Hourly counts of the same stream: what comes late is not in them."""
    return _plain(live.drained(live.tumbling(_arriving(t), "1 hour", ["event_type"])))


@query("SELECT props, count(*) AS n FROM (SELECT props FROM events GROUP BY props) GROUP BY props")
def stream_first_seen(t: Tables) -> DataFrame:
    """Bodies of a stream with how often each is given out: once, as all of the stream lies within the watermark."""
    return live.drained(live.first_seen(_stream(t), "props", "400 days")).groupBy("props").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INTERVALS} SELECT * FROM intervals WHERE off_ts <= {_MARK.replace('FROM events', "FROM events WHERE event_type IN ('signup', 'purchase')")}")
def stream_toggles(t: Tables) -> DataFrame:
    """On-intervals that ended before the watermark, from keyed state."""
    live.with_rocks(t.spark)
    rows = _stream(t).where(F.col("event_type").isin("signup", "purchase")).select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("is_off"))
    return _plain(live.drained(live.toggles(rows)))


@query(f"""
    WITH late AS (SELECT user_id, min(ts) AS hit FROM events WHERE event_type = 'signup' AND ts > TIMESTAMP '2024-01-15' GROUP BY 1),
    s AS (SELECT e.user_id, ts, event_id, value * CASE WHEN ts >= hit AND event_type = 'error' THEN 9 ELSE 1 END AS value, hit IS NULL OR ts < hit AS before FROM events e LEFT JOIN late USING (user_id)),
    base AS (SELECT user_id, avg(value) FILTER (before) + 3 * coalesce(stddev_samp(value) FILTER (before), 0) AS edge FROM s GROUP BY 1)
    SELECT user_id, min(ts) AS onset FROM s JOIN base USING (user_id) WHERE NOT before AND value > edge AND ts <= {_MARK} GROUP BY 1
""")
def stream_onsets(t: Tables) -> DataFrame:
    """Onsets after each series' incident, found while it runs."""
    live.with_rocks(t.spark)
    first = t.events.where("event_type = 'signup' and ts > timestamp_ntz '2024-01-15'").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("hit"))
    rows = _stream(t).join(first, "user_id", "left")
    after = F.coalesce(F.col("ts") >= F.col("hit"), F.lit(False))
    value = F.col("value") * F.when(after & (F.col("event_type") == "error"), 9).otherwise(1)
    return _plain(live.drained(live.onsets(rows.select("user_id", "ts", "event_id", value.cast("double").alias("value"), after.alias("incident")))))
