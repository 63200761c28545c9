from __future__ import annotations

from pyspark.sql import functions as F

from quern.streaming import operators as live


def source(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "event_id int, user_id long, minute int, kind string").withColumn("ts", F.timestamp_micros(F.col("minute").cast("long") * 60_000_000))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))


ROWS = [(1, 1, 0, "on"), (2, 1, 10, "on"), (3, 1, 20, "off"), (4, 2, 5, "off"), (5, 2, 100, "on"), (6, 1, 70, "on"), (7, 1, 90, "off")]
#: An event long after the others moves the watermark past them.
LATER = (99, 9, 10_000, "late")


#: Times of in_batches begin here: what lies at the epoch itself counts as late from the start.
BASE = 60


def minutes(rows, *columns):
    return sorted(tuple(int(r[c].timestamp() // 60) - BASE if hasattr(r[c], "timestamp") else r[c] for c in columns) for r in rows)


def test_sessions_and_first_seen(spark, tmp_path):
    got = live.drained(live.sessions(source(spark, tmp_path, [*ROWS, LATER]), "30 minutes", "user_id")).collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 2), (1, 3), (2, 1), (2, 1)]
    kinds = live.drained(live.first_seen(source(spark, tmp_path / "b", ROWS), "kind")).collect()
    assert sorted(r.kind for r in kinds) == ["off", "on"]


def in_batches(spark, tmp_path, batches, columns):
    """A stream that reads one file to a batch, in the order of the batches."""
    for k, rows in enumerate(batches):
        table = spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_micros((F.col("minute") + BASE).cast("long") * 60_000_000))
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_toggle_state_waits_for_rows_that_come_late(spark, tmp_path):
    live.with_rocks(spark)
    # The off of minute 20 arrives a batch after the on of minute 70.
    batches = [[ROWS[0], ROWS[1], ROWS[5]], [ROWS[2], ROWS[3], ROWS[4]], [ROWS[6]], [LATER]]
    stream = in_batches(spark, tmp_path, batches, "event_id long, user_id long, minute int, kind string").withColumn("is_off", F.col("kind") == "off")
    got = live.drained(live.toggles(stream.select("user_id", "ts", "event_id", "is_off"), "2 hours")).collect()
    assert minutes(got, "user_id", "on_ts", "off_ts") == [(1, 0, 20), (1, 70, 90)]


def test_onset_state(spark, tmp_path):
    live.with_rocks(spark)
    calm = [(k, 1, k, 10.0 + k % 2, False) for k in range(8)]
    rows = [*calm, (20, 1, 20, 11.0, True), (21, 1, 21, 50.0, False), (22, 1, 22, 60.0, False), (30, 2, 5, 0.0, False), (31, 2, 6, 0.0, True), (32, 2, 7, 1.0, False), (99, 9, 10_000, 0.0, False)]
    stream = in_batches(spark, tmp_path, [rows], "event_id long, user_id long, minute int, value double, incident boolean")
    got = live.drained(live.onsets(stream.select("user_id", "ts", "event_id", "value", "incident"))).collect()
    assert minutes(got, "user_id", "onset") == [(1, 21), (2, 7)]


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    from quern.plans.catalogue import oracle_sql, queries

    import duckdb

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_tumbling", "stream_sliding"):
        want = con.sql(oracle_sql()[name]).fetchall()
        assert queries()[name](spark, str(tmp_path)).count() == len(want) > 0


def test_late_rows_are_those_that_spark_drops(spark, tmp_path):
    """Rows behind the mark in a table, as many as Spark's own counter says; a row is judged by the mark of the batch before."""
    rows = lambda *m: [(k, 1, minute, "x") for k, minute in enumerate(m)]
    batches = [rows(0, 500), rows(10, 600), rows(20, 380, 500, 900), rows(430, 445, 900), rows(30, 1000)]
    stream = in_batches(spark, tmp_path, batches, "event_id long, user_id long, minute int, kind string")
    late = live.late_rows(stream, "1 hour")
    assert minutes(late.collect(), "batch", "ts") == [(2, 20), (2, 380), (3, 430), (3, 445), (4, 30)]
    seen = stream.withWatermark("ts", "1 hour").dropDuplicates(["ts"])
    q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == late.count()


def test_waiting_rows_lie_in_buckets_of_time(spark, tmp_path):
    """Rows of many hours in any order, over batches that each advance the mark a little."""
    live.with_rocks(spark)
    import random

    rng = random.Random(4)
    events = [(k, k % 2, k * 17, k % 3 == 2) for k in range(300)]
    batches = [events[k * 30 : (k + 1) * 30] for k in range(10)]
    for b in batches:
        rng.shuffle(b)
    last = [(999, 9, 100_000, False)]
    stream = in_batches(spark, tmp_path, [*batches, last], "event_id long, user_id long, minute int, is_off boolean")
    got = live.drained(live.toggles(stream.select("user_id", "ts", "event_id", "is_off"), "12 hours")).collect()
    want = []
    for user in (0, 1):
        on = None
        for k, u, minute, is_off in events:
            if u == user:
                if is_off and on is not None:
                    want.append((user, on, minute))
                    on = None
                elif not is_off and on is None:
                    on = minute
    assert minutes(got, "user_id", "on_ts", "off_ts") == sorted(want)


def test_few_calls_to_state_for_a_key(spark):
    """Rows that wait are added in one call, whatever their hours; long lists are dealt to buckets, and all come out in order."""
    from collections import Counter
    from datetime import datetime, timedelta, timezone

    calls = Counter()

    class State:
        def __init__(self, kind):
            self.kind, self.held = kind, {} if kind == "map" else None

        def __getattr__(self, name):
            def call(*args):
                calls[f"{self.kind}.{name}"] += 1
                if name == "appendList":
                    self.held = [*(self.held or []), *args[0]]
                elif name in ("put", "update"):
                    self.held = args[0]
                elif name == "clear":
                    self.held = None
                elif name == "get":
                    return iter(self.held or []) if self.kind == "list" else self.held
                elif name == "updateValue":
                    self.held[args[0]] = args[1]
                elif name == "removeKey":
                    del self.held[args[0]]
                elif name == "containsKey":
                    return args[0] in self.held
                elif name == "getValue":
                    return self.held[args[0]]
                elif name == "keys":
                    return iter(list(self.held))

            return call

    class Handle:
        getListState, getMapState, getValueState = (lambda self, *a, k=k: State(k) for k in ("list", "map", "value"))

        def registerTimer(self, ms):
            calls["timer"] += 1

    zero = datetime(1970, 1, 2, tzinfo=timezone.utc)
    rows = [(zero + timedelta(hours=k), k, k % 3 == 2) for k in range(60)]
    want = [(zero + timedelta(hours=k), zero + timedelta(hours=k + 2)) for k in range(0, 60, 3)]
    for most in (2_000, 7):
        switch = live.Toggle()
        switch.MOST_LISTED = most
        switch.init(Handle())
        calls.clear()
        at = lambda k: int((zero + timedelta(hours=k)).timestamp() * 1000)
        out = [*switch._advance((1,), rows[::-1][:30], 0), *switch._advance((1,), rows[:30], 0)]
        assert out == [] and sum(calls.values()) <= 9
        for hour in (10, 10.5, 31, 44, 59):
            out += [tuple(r[1:]) for part in switch._advance((1,), [], at(hour)) for r in part.itertuples(index=False)]
        assert out == want
        assert (calls["map.updateValue"] > 0) == (most == 7)
        assert switch.listed.held is None and switch.waiting.held == {} and switch.places.held is None
