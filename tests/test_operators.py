from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import promql, text, times
from quern.operators import checks, cost, onset, ordering, split, stats, timeline, trajectory, verdicts


def graded(spark, tasks):
    rows = spark.createDataFrame([("g", t, None if v is None else float(v)) for t, values in tasks.items() for v in values], "g string, t string, v double")
    r = stats.graded_accuracy(rows, ["g"], ["t"], "v").first()
    return r and (r.n_tasks, r.n_trials, r.mean, r.se)


def test_graded_accuracy_is_a_mean_over_trials(spark):
    # Unbalanced: the mean of task means would be 0.55.
    n, k, mean, se = graded(spark, {"a": [1, 0.2, 0.3], "b": [0.6]})
    var = sum((x - 0.5) ** 2 for x in (1, 0.2, 0.3)) / 2
    assert (n, k) == (2, 4) and math.isclose(mean, 0.525) and math.isclose(se, math.sqrt(var / 3 / 4))
    # One trial each: the spread between tasks.
    n, k, mean, se = graded(spark, {"a": [0.1], "b": [0.4], "c": [1]})
    var = sum((x - 0.5) ** 2 for x in (0.1, 0.4, 1)) / 2
    assert math.isclose(mean, 0.5) and math.isclose(se, math.sqrt(var / 3))
    assert graded(spark, {"a": [1]}) == (1, 1, 1.0, 0.0)


def test_graded_accuracy_leaves_out_what_was_not_scored(spark):
    assert graded(spark, {"a": [None, None], "b": [0.25, None]}) == (1, 1, 0.25, 0.0)
    assert graded(spark, {"a": [None]}) is None


@pytest.mark.parametrize("bad", [1.5, -0.1])
def test_rewards_outside_their_range_stop_the_job(spark, bad):
    rows = spark.createDataFrame([(0.0,), (1.0,), (None,)], "r double").select(stats.checked_reward(F.col("r")).alias("r"))
    assert [r.r for r in rows.collect()] == [0.0, 1.0, None]
    with pytest.raises(Exception, match="reward outside"):
        spark.range(1).select(stats.checked_reward(F.lit(bad))).collect()


def test_published_metrics_need_labels_and_trials(spark):
    trials = spark.createDataFrame([("g", "a", 1.0, 0.0), ("g", "a", 0.0, None), ("g", "b", 1.0, 1.0), ("g", "c", 1.0, 1.0)], "g string, task string, rca_accuracy double, hallucinate_any double")
    labels = spark.createDataFrame([("a", "medium", False), ("b", "hard", False), ("c", "hard", True)], "task string, difficulty string, is_control boolean")
    found = {r.key: (r["mean"], r.n) for r in checks.published(checks.labelled(trials, labels), ["g"]).collect()}
    assert found == {"rca_accuracy_incident_medium": (50.0, 2), "rca_accuracy_incident_hard": (100.0, 1), "hallucinate_any_incident": (50.0, 2)}
    with pytest.raises(Exception, match="no label for task c"):
        checks.labelled(trials, labels.where("task <> 'c'")).collect()
    with pytest.raises(Exception, match="no trials for rca_accuracy_incident_hard"):
        checks.published(checks.labelled(trials.where("task = 'a'"), labels), ["g"]).collect()


def test_padding_and_quadrature(spark):
    row = spark.range(1).select(*stats.padded_mean_sem(F.lit(6.0), F.lit(20.0), F.lit(4.0)), stats.in_quadrature(F.lit(3.0), F.lit(4.0)))
    mean, sem, both = row.first()
    values = [2.0, 4.0, 0.0, 0.0]
    var = sum((v - 1.5) ** 2 for v in values) / 3
    assert mean == 1.5 and math.isclose(sem, math.sqrt(var) / 2) and both == 5


def test_ranks_share_places(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "k string, v double")
    assert [(r.k, r["rank"]) for r in stats.ranked(rows, "v", ["k"]).collect()] == [("b", 1), ("c", 1), ("a", 3), ("d", 4)]


def test_verdict_rules(spark):
    rows = spark.createDataFrame([("judged", 1, "(no_incident)", None), ("empty_report", 2, "x", None), ("judged", 2, "x", True), ("judged", 2, "x", None)], "m string, n int, f string, hit boolean")
    assert [r[0] for r in rows.select(verdicts.hallucinated(F.col("m"), F.col("n"), F.col("f"), F.col("hit"))).collect()] == [None, False, False, True]
    reports = spark.createDataFrame([("It was CART ", " cart", False), (None, "cart", False), ("  ", "x", True), ("x", "x", True)], "r string, c string, k boolean")
    assert [r[0] for r in reports.select(verdicts.string_match_score(F.col("r"), F.col("c"), F.col("k"))).collect()] == [3, 0, 3, 0]


def test_intervals_and_as_of(spark):
    toggles = spark.createDataFrame([("f", m, k, off) for k, (m, off) in enumerate([(0, True), (10, False), (20, False), (30, True), (40, True), (50, False)])], "k string, m int, i int, is_off boolean")
    toggles = toggles.withColumn("ts", F.timestamp_micros(F.col("m").cast("long") * 60_000_000).cast("timestamp_ntz"))
    minutes = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 60_000_000).cast("int")
    found = timeline.toggle_intervals(toggles, ["k"], "ts", "is_off", "i")
    assert [tuple(r) for r in found.select(minutes("on_ts"), minutes("off_ts")).orderBy("on_ts").collect()] == [(10, 30), (50, None)]
    points = spark.range(0, 60, 5).select(F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("at"))
    last = F.timestamp_micros(F.lit(60 * 60_000_000)).cast("timestamp_ntz")
    inside = timeline.within(points, found.drop("k"), "at", "on_ts", "off_ts", 600, open_until=last).select(minutes("at")).collect()
    assert sorted(r[0] for r in inside) == [10, 15, 20, 25, 50, 55]
    marks = toggles.where("is_off").select("ts")
    nxt = timeline.next_after(points, marks, "at", "ts", "x").select(minutes("at"), minutes("x")).collect()
    assert {a: b for a, b in nxt} == {m: next((o for o in (0, 30, 40) if o > m), None) for m in range(0, 60, 5)}
    old = timeline.last_at(points, marks, "at", "ts", "x").select(minutes("at"), minutes("x")).collect()
    assert {a: b for a, b in old} == {m: max(o for o in (0, 30, 40) if o <= m) for m in range(0, 60, 5)}


@pytest.mark.parametrize("spread", [50, 10**6, 10**9, 10**12, 10**16])
def test_as_of_picks_at_every_spacing(spark, spread):
    """Against bisect: microseconds to centuries, before and after 1970, repeated times, null times and keys, marks that carry values."""
    rng = random.Random(spread)
    at = lambda: rng.choice([rng.randrange(-spread, spread), rng.randrange(-9, 9)])
    marks = [(rng.choice("ab"), at(), i) for i in range(300)]
    points = [(rng.choice(["a", "b", "c", None]), rng.choice([at(), at(), at(), None]), i) for i in range(400)]
    stamp = F.timestamp_micros("t").cast("timestamp_ntz")
    m = spark.createDataFrame(marks, "k string, t long, v int").select("k", stamp.alias("mark"), "v")
    p = spark.createDataFrame(points, "k string, t long, i int").select("k", stamp.alias("ts"), "i")
    micros = timeline.micros
    for keys in ([], ["k"]):
        for pick, forward in ((timeline.next_after, True), (timeline.last_at, False)):
            found = {r.i: (r.x, r.v) for r in pick(p, m if keys else m.drop("k"), "ts", "mark", "out", keys, carry=["v"]).select("i", micros(F.col("out")).alias("x"), "v").collect()}
            assert len(found) == len(points)
            for k, t, i in points:
                own = [(u, v) for key, u, v in marks if t is not None and (not keys or key == k) and (u > t if forward else u <= t)]
                assert found[i] == ((min(own) if forward else max(own)) if own else (None, None))


def test_as_of_grows_with_the_rows(spark):
    """Four times the rows in one bucket of time take less than six times as long: frames run, they don't start anew."""
    def took(n):
        sides = [spark.range(n).select(F.timestamp_micros(F.col("id") * 2 + k).cast("timestamp_ntz").alias("t")) for k in (0, 1)]
        began = time.perf_counter()
        timeline.next_after(sides[0], sides[1].withColumnRenamed("t", "mark"), "t", "mark", "x").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(1000)
    assert took(400_000) < 6 * max(1.0, took(100_000))


def test_moves_and_quarters(spark):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 5, "a"), (1, 9, "c")], "t int, s int, c string")
    moves = {(r.prev, r.next): (r.weight, r.p) for r in trajectory.normalised(trajectory.transitions(steps, ["t"], "s", "c")).collect()}
    assert moves == {("a", "a"): (0.5, 1 / 3), ("b", "a"): (0.5, 1.0), ("a", "c"): (1.0, 2 / 3)}
    n = 6
    q = [r[0] for r in spark.range(1, n + 1).select(trajectory.quarter(F.col("id"), F.lit(n))).collect()]
    assert q == [sum(k >= int(i * n / 4) for i in (1, 2, 3)) for k in range(n)]


def price(spark, prompt, completion, prices, **more):
    lit = lambda x: F.lit(x) if isinstance(x, bool) else F.lit(x).cast("double")
    return spark.range(1).select(cost.token_cost(lit(prompt), lit(completion), {k: lit(v) for k, v in prices.items()}, **{k: lit(v) for k, v in more.items()})).first()[0]


def test_cost_rules(spark):
    base = {"input": 3, "output": 11}
    assert math.isclose(price(spark, 900, 20, base | {"cached_input": 0.5}, cached=300), (600 * 3 + 300 * 0.5 + 220) / 1e6)
    # A read without a price costs nothing; a write without one costs what input costs.
    assert math.isclose(price(spark, 900, 20, base, cached=300), (600 * 3 + 220) / 1e6)
    assert math.isclose(price(spark, 900, 20, base | {"cache_creation_5m": 0, "cache_creation_1h": 7}, write_5m=100, write_1h=200), (600 * 3 + 100 * 3 + 200 * 7 + 220) / 1e6)
    assert math.isclose(price(spark, 900, 20, base | {"context_cache_read": 1, "cached_input": 0.5}, cached=300), (600 * 3 + 300 + 220) / 1e6)
    assert price(spark, 100, 0, base, cached=300) == 0
    long = base | {"input_over_200k": 6, "output_over_200k": 22, "cached_input": 1, "cached_input_over_200k": 2}
    assert math.isclose(price(spark, 200_000, 10, long, cached=100), (199_900 * 3 + 100 + 110) / 1e6)
    assert math.isclose(price(spark, 200_001, 10, long, cached=100), (199_901 * 6 + 200 + 220) / 1e6)
    assert math.isclose(price(spark, 10, 5, base, thinking=4), (30 + 99) / 1e6)
    assert math.isclose(price(spark, 10, 5, base, thinking=4, thinking_included=True), (30 + 55) / 1e6)
    assert price(spark, 10, 5, {"output": 11}) is None


def test_split_is_the_fold_that_it_says(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("s"), (F.col("id") * F.col("id") % 60).alias("g"))
    pins = spark.createDataFrame([(0,), (1,), (4,)], "g long")
    found = split.assigned(rows, "s", "g", 0.7, 5, pins).collect()
    sizes = {}
    for k in range(1000):
        sizes[k % 3, k * k % 60] = sizes.get((k % 3, k * k % 60), 0) + 1
    want = {}
    for s in range(3):
        mine = {g: n for (t, g), n in sizes.items() if t == s}
        held, target = sum(n for g, n in mine.items() if g in (0, 1, 4)), 0.7 * sum(mine.values())
        for g in sorted(mine, key=lambda g: (hashlib.md5(f"5:{g}".encode()).hexdigest(), g)):
            take = g not in (0, 1, 4) and abs(held + mine[g] - target) < abs(held - target)
            held += mine[g] if take else 0
            want[s, g] = "public" if take or g in (0, 1, 4) else "private"
    assert {(r.s, r.g): r.side for r in found} == want
    with pytest.raises(Exception, match="not built: 77"):
        split.complete(rows, spark.createDataFrame([(0,), (77,)], "g long"), "g").collect()


def test_text_rules(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(text.main_category(F.array(F.lit("code:ls"), F.lit("telemetry:grafana_health")))) == "Code"
    assert f(text.main_category(F.array(F.lit("code:ls"), F.lit("telemetry:logs")))) == "Telemetry"
    assert f(text.main_category(F.array(F.lit("control:wait")))) == "Other"
    assert f(text.telemetry_type(F.array(F.lit("telemetry:spans"), F.lit("telemetry:docker_logs")))) == "logs"
    assert f(text.telemetry_type(F.array(F.lit("telemetry:grafana_health")))) is None
    assert f(text.family(F.lit("x_bucket"))) == "x" and f(text.family(F.lit("_total"))) == "_total"
    assert f(text.family(F.lit("rpc_duration_seconds"))) == "rpc_duration_seconds" and f(text.family(F.lit("load_avg"))) == "load"
    assert f(text.slug(F.lit("  Claude 4.6/Sonnet! "))) == "claude-4-6-sonnet" and f(text.slug(F.lit(None).cast("string"))) == "none"
    assert f(text.display_name(F.lit("x/openai-some-model-20250101"))) == "some-model" and f(text.display_name(F.lit("gem-3-pro-preview"))) == "gem-3-pro"
    assert f(text.model_name(F.lit("gradient_ai/anthropic-claude"))) == "claude" and f(text.model_name(F.lit("x"))) == "x"
    assert f(text.model_of_label(F.lit("t-1 (glm-5) (high)"))) == "GLM-5" and f(text.model_of_label(F.lit("plain"))) == "plain"
    assert f(text.printable(F.lit("\x1b[31mred\x1b[0m\x07"))) == "red"
    assert f(text.fenced_json(F.lit('so:\n```json\n{"a": 1}\n```\n'))) == '{"a": 1}'
    assert f(text.section(F.lit("# T\n## Mechanism\n\nbody\nmore\n\n## Next\nx"), "Mechanism")) == "body\nmore"
    assert f(text.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'
    lists = {"['a', \"b c\"]": ["a", "b c"], "[]": [], "nan": [], "None": [], "": [], "['a', 3, None, True]": ["a", "3", None, "True"], "[ 'x' ,]": ["x"], "['a'": [], "['a' 'b']": [], "x": []}
    for cell, want in lists.items():
        assert f(text.parsed_list(F.lit(cell))) == want, cell
        assert f(text.malformed_list(F.lit(cell))) == (cell in ("['a'", "['a' 'b']", "x"))
    assert f(text.parsed_list(F.lit(None).cast("string"))) == []


def test_lists_as_python_writes_and_reads_them(spark):
    import ast

    rng = random.Random(3)
    letters = ["a", "'", '"', "\\", "n", "\n", "\t", "\r", ",", "[", "]", " ", "é", "漢", "😀", "\x00", "\x1b", "\x7f", "x41", "u0041"]
    lists = [["".join(rng.choices(letters, k=rng.randrange(6))) for _ in range(rng.randrange(4))] for _ in range(400)]
    rows = spark.createDataFrame([(i, x, repr(x)) for i, x in enumerate(lists)], "i int, x array<string>, python string")
    for r in rows.select("*", text.written_list(F.col("x")).alias("own"), text.parsed_list(F.col("python")).alias("read"), text.malformed_list(F.col("python")).alias("bad")).collect():
        assert r.own == repr(lists[r.i]) and r.read == lists[r.i] and not r.bad
    odd = [r"['\x41\u00e9\U0001F600\101\q']", r'["\a\b\f\v"]', "['it\\'s', \"so\"]"]
    for r in spark.createDataFrame([(x,) for x in odd], "x string").select("x", text.parsed_list(F.col("x")).alias("read")).collect():
        assert r.read == ast.literal_eval(r.x)


def test_places_over_whole_tables(spark):
    names = ["b10/t2", "b9/t10", "b9/t9", "b9/t" + "9" * 30, "b9/t" + "9" * 29 + "8", "b9/t0010a", "b9/t", "7", "a", "A1", "b09/t9b", "t1234567890123", "t1234567890129", "t"]
    parts = lambda x: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", x)]
    rows = spark.createDataFrame([(x,) for x in names], "x string").repartition(4)
    found = {r.place: r.x for r in ordering.placed(rows, [ordering.natural_key(F.col("x")), "x"]).collect()}
    assert [found[k + 1] for k in range(len(names))] == sorted(names, key=lambda x: (parts(x), x))
    many = ordering.placed(spark.range(20000).select((F.col("id") * 7919 % 20000).alias("v")), ["v"])
    assert many.where("place <> v + 1").count() == 0


def test_greedy_fill_equals_the_fold(spark):
    rng = random.Random(8)
    tasks, pins = [], [(g,) for g in range(0, 400, 90)]
    for s in "abcd":
        for g in range({"a": 400, "b": 30, "c": 3, "d": 200}[s]):
            tasks += [(s, g)] * (1 if s == "d" else rng.choice([1, 1, 2, 5, 40, 300]))
    rows = spark.createDataFrame([*tasks, (None, 1), (None, 2)], "s string, g int")
    for fraction in (0.0, 0.3, 0.7, 1.0):
        found = {(r.s, r.g): r.side for r in split.assigned(rows, "s", "g", fraction, 5, spark.createDataFrame(pins, "g int")).collect()}
        sizes = {}
        for key in [*tasks, (None, 1), (None, 2)]:
            sizes[key] = sizes.get(key, 0) + 1
        assert found.keys() == sizes.keys()
        for s in ("a", "b", "c", "d", None):
            own = {g: n for (k, g), n in sizes.items() if k == s}
            target, fixed = fraction * sum(own.values()), {g for g, in pins}
            held = sum(n for g, n in own.items() if g in fixed)
            for g in sorted(own, key=lambda g: hashlib.md5(f"5:{g}".encode()).hexdigest()):
                take = g not in fixed and abs(held + own[g] - target) < abs(held - target)
                held += own[g] if take else 0
                assert found[s, g] == ("public" if take or g in fixed else "private")


def test_alignment_by_an_index(spark):
    rng = random.Random(6)
    for _ in range(200):
        texts = ["".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(rng.randrange(8))]
        needles = ["".join(rng.choices("ab", k=rng.randrange(4))) for _ in range(6)]
        where = trajectory.Places(needles, texts)
        for n in filter(None, needles):
            for start in range(9):
                assert where.first(n, start) == next((k for k in range(start, len(texts)) if n in texts[k]), None)
    # 100,000 calls that all miss, and some that are there: one pass, not one for each.
    n = 100_000
    calls = spark.range(n).select(F.lit("t").alias("t"), F.col("id").alias("c"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("in "), (F.col("id") / 1000).cast("int").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("missing "), "id")).alias("cmd"))
    inputs = spark.range(n).select(F.lit("t").alias("t"), F.col("id").alias("k"), F.concat(F.lit("in "), "id", F.lit(".")).alias("data"))
    began = time.perf_counter()
    found = trajectory.aligned(calls, inputs, "t", "c", "cmd", "k", "data").where("place is not null").collect()
    assert sorted((r.c, r.place) for r in found) == [(k * 1000, k) for k in range(100)]
    assert time.perf_counter() - began < 60


def test_rates_across_buckets(spark):
    """Against plain sums, with resets, gaps of any size and repeated times; one series, ranges below and above the width of a bucket."""
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([0, 1, 10**6, 10**8, promql.SPAN // 3, promql.SPAN * 5])
        rows.append((at, float(rng.randrange(50)), i))
    table = spark.createDataFrame(rows, "t long, v double, i int").withColumn("ts", F.timestamp_micros("t")).repartition(4)
    rise = [0.0] + [b if b < a else b - a for (_, a, _), (_, b, _) in zip(rows, rows[1:])]
    for seconds in (60, 300, 1073, 10_000):
        found = {r.i: r.rate for r in promql.rate(table, [], "ts", "v", seconds, tie="i").collect()}
        for t, _, i in rows:
            want = sum(x for (u, _, _), x in zip(rows, rise) if t - seconds * 1_000_000 < u <= t) / seconds
            assert math.isclose(found[i], want, abs_tol=1e-12)


def test_hot_series_spreads_over_tasks(spark):
    table = spark.range(400_000).select(F.timestamp_micros(F.col("id") * 100_000).alias("ts"), (F.col("id") % 977).cast("double").alias("v"), F.lit("one").alias("s"))
    rows = promql.rate(table, ["s"], "ts", "v", 30).select("rate", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in rows) == 400_000 and max(r["count"] for r in rows) < 300_000


def test_promql_reading(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    q = F.lit('sum(rate(x_total{b="2",a="1"}[5m]))')
    assert f(promql.metric_name(q)) == "x_total" and f(promql.label_text(q)) == "a=1,b=2"
    assert f(promql.label_text(F.lit("x{a='1'}"))) == ""
    assert f(promql.label_text(F.lit('x{a!="1",b !~ "2", c=~"3",a="4"} / y{d="5"}'))) == "a=4,b=2,c=3"
    assert promql.parsed('avg without (cpu) (x{a!="1"}) / sum(rate(y[2m])) by (z)') == promql.Binary(
        "/", promql.Aggregate("avg", promql.Selector("x", (("a", "!=", "1"),)), "without", ("cpu",)), promql.Aggregate("sum", promql.Rate("rate", promql.Selector("y", (), 120)), "by", ("z",))
    )
    for bad in ("rate(x)", "sum(x", 'x{a~"1"}', "x y"):
        with pytest.raises(ValueError):
            promql.parsed(bad)


def test_onsets_spike_appear_and_collapse(spark):
    at = lambda m: F.timestamp_micros(F.col(m).cast("long") * 60_000_000).cast("timestamp_ntz")
    flat = [("spike", m, 10.0 + m % 2) for m in range(10)] + [("spike", 12, 12.0), ("spike", 13, 20.0), ("spike", 14, 30.0)]
    rows = flat + [("new", 3, 0.0), ("new", 11, 0.0), ("new", 12, 0.1)] + [("gone", 3, 1.0), ("gone", 9, 1.0), ("gone", 12, 0.0)] + [("calm", 5, 1.0), ("calm", 11, 1.0)]
    series = spark.createDataFrame(rows, "k string, m int, v double").withColumn("ts", at("m"))
    inc = series.select("k").distinct().withColumn("m", F.lit(10)).withColumn("hit", at("m"))
    minute = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 60_000_000).cast("int").alias(c)
    found = onset.onsets(series, inc, ["k"], "ts", "v", "hit").select("k", minute("spiked"), minute("collapsed"))
    assert {r.k: (r.spiked, r.collapsed) for r in found.collect()} == {"spike": (13, None), "new": (12, None), "gone": (None, 9), "calm": (None, None)}


def test_configurations_are_checked(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    config = F.create_map(F.lit("environment.override_cpus"), F.lit("8"), F.lit("agent_timeout_multiplier"), F.lit("2"), F.lit("agent.name"), F.lit("x"), F.lit("verifier.max_timeout_sec"), F.lit(None).cast("string"))
    assert f(checks.config_failures(F.lit(1.0), config)) == ["agent_timeout_multiplier=2", "environment.override_cpus=8"]
    assert f(checks.config_failures(F.lit(1.5), config))[0] == "timeout_multiplier=1.5"
    assert f(checks.retryable(F.lit("RateLimitError"))) and not f(checks.retryable(F.lit("AuthenticationError"))) and not f(checks.retryable(F.lit("KeyError")))
    boards = spark.createDataFrame([("public", "a"), ("private", "b")], "board string, dataset string")
    subs = lambda *b: spark.createDataFrame([(x,) for x in b], "board string")
    assert sorted(r.dataset for r in checks.routed(subs(None, "private"), boards).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="unknown board: x"):
        checks.routed(subs("x"), boards).collect()


def test_reported_times_cross_a_change_of_clocks(spark):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    f = lambda c: spark.range(1).select(c).first()[0]
    # Clocks in New York go from 1:59 to 3:00 on 2024-03-10 at 07:00 UTC.
    got = f(times.reported_exact(ts("2024-03-10 06:30:00"), ts("2024-03-10 09:00:00"), F.lit(60), F.lit("at")))
    assert got.styled == "at 3:30 AM today ET"
    day = f(times.reported_day(ts("2024-03-10 12:00:00"), ts("2024-03-11 12:00:00"), 0))
    assert day.styled == "sometime yesterday" and (day.stop - day.start).total_seconds() == 23 * 3600
    early = f(times.reported_period(ts("2024-03-10 06:30:00"), ts("2024-03-10 09:00:00"), -1))
    assert early.styled == "sometime in the night yesterday"


@pytest.mark.parametrize("day, hours", [("2024-03-10", 23), ("2024-11-03", 25), ("2024-06-01", 24)])
def test_local_days_have_their_length(spark, day, hours):
    ts = F.lit(f"{day} 15:00:00").cast("timestamp_ntz")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    assert spark.range(1).select(us(times.day_end(ts)) - us(times.day_start(ts))).first()[0] == hours * 3_600_000_000
    assert spark.range(1).select(times.offset_minutes(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 00:00:30").cast("timestamp_ntz"))).first()[0] == -1


def test_each_rubric_has_those_of_all_other_flags(spark):
    from quern.operators import answers

    rows = spark.createDataFrame([(4, "a"), (1, "b"), (3, "a"), (9, None), (2, "c"), (7, "b")], "k long, flag string")
    found = {r.k: (r.others, r.n_prior) for r in answers.with_others(answers.with_priors(rows, "k", "flag"), "k", "flag").collect()}
    assert found == {4: ([1, 2, 9], 1), 3: ([1, 2, 9], 1), 1: ([2, 3, 9], 1), 7: ([2, 3, 9], 1), 2: ([1, 3, 9], 0), 9: ([1, 2, 3], 0)}
    assert answers.with_others(rows.limit(0), "k", "flag").collect() == []


def test_texts_of_the_other_rubrics_are_cut_from_one(spark):
    """Equal keys under several flags, a flag or keys that are null, numbers that are part of others, one flag alone; no row goes through a list."""
    from quern.operators import answers

    awkward = [(5, 1), (5, 2), (5, 3), (55, 4), (555, 4), (15, None), (None, None), (None, 5), (-5, 6), (7, 1), (51, 7), (1, 8), (1, 8)]
    for told in (awkward, [(3, 9), (4, 9)], [(None, 9)], []):
        rows = spark.createDataFrame(told, "k long, flag long")
        want = answers.with_others(answers.with_priors(rows, "k", "flag"), "k", "flag")
        want = want.select("k", "flag", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"), "n_prior").collect()
        got = answers.with_others_text(rows, "k", "flag")
        assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == len(told)
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_parts_grow_with_a_table(spark, monkeypatch):
    from quern.plans import registry

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert registry.parts_for(spark.range(100)) == least
    monkeypatch.setattr(registry, "ROWS_EACH", 10)
    assert registry.parts_for(spark.range(10 * least + 15)) == least + 2


def test_members_of_intervals_are_those_of_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(timeline, "LISTED", 3)
    rng = random.Random(5)
    points = [(k, rng.choice([0, 900, 1800, rng.randrange(7200)])) for k in range(40)] + [(40, None), (None, 900)]
    spans = [(k, a, a + rng.choice([0, 1, 900, 5000])) for k in range(30) for a in [rng.choice([0, 900, rng.randrange(7200)])]] + [(30, None, 900), (31, 900, None)]
    p = spark.createDataFrame(points, "p long, s int").selectExpr("p", "timestamp_ntz'2024-03-10 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) as ts")
    i = spark.createDataFrame(spans, "i long, a int, b int").selectExpr("i", *[f"timestamp_ntz'2024-03-10 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {x}) as {n}" for x, n in (("a", "lo"), ("b", "hi"))])
    found = sorted(((r.i, r.p) for r in timeline.members(p, i, "ts", "lo", "hi", 1000, "p").collect()), key=str)
    assert found == sorted(((k, q) for k, a, b in spans for q, t in points if None not in (a, b, t) and a <= t < b), key=str) and len(found) > 50
