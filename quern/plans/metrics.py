"""Metric series and PromQL. Stand-ins: a user is a series, event values are samples of a counter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import promql, text
from quern.operators import families, onset
from quern.operators.timeline import micros
from quern.plans.registry import Tables, parts_for, query, r6

# Query texts made of parts: four forms, nine endings of names, four matchers, labels in either order.
_ENDINGS = ["_count", "_sum", "_bucket", "_total", "_created", "_avg", "_max", "_min", "_seconds"]
_MATCHERS = ["=", "!=", "=~", "!~"]


def _queries(t: Tables) -> DataFrame:
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    key, name = F.col("p_partkey"), F.concat(F.lower("p_type"), pick(_ENDINGS, F.col("p_partkey") % 9))
    brand = F.concat(F.lit("brand"), pick(_MATCHERS, key % 4), F.lit('"'), F.col("p_brand"), F.lit('"'))
    size = F.concat(F.lit('size="'), (F.col("p_size") % 3).cast("string"), F.lit('"'))
    body = F.concat(name, F.lit("{"), F.when(key % 2 == 0, F.concat(brand, F.lit(","), size)).otherwise(F.concat(size, F.lit(", "), brand)), F.lit("}"))
    forms = {0: ("rate(", "[5m])"), 1: ("sum(rate(", "[2m]))"), 2: ("", ""), 3: ("avg(log2(rate(increase(max(", "[5m1s]))))) * 60")}
    whole = F.coalesce(*[F.when(F.col("p_size") % 4 == k, F.concat(F.lit(a), body, F.lit(b))) for k, (a, b) in forms.items()])
    return t.part.select("p_partkey", "p_type", "p_brand", "p_size", whole.alias("q"))


_PEELED = "q"
for _ in range(7):
    _PEELED = rf"regexp_replace({_PEELED}, '^\w+\((.+)\)[^)]*$', '\1', 's')"


@query(rf"""
    WITH f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'avg without (cpu) (' || p_type || '{{a="1"}})' WHEN 1 THEN 'a(b(c(d(e(f(' || p_type || '[5m])))))) + 1' WHEN 2 THEN 'log2(' || p_type || '{{x="("}}' || ')' WHEN 3 THEN 'sum(rate(x[1h:5m])) / sum(rate(' || p_type || '[2m]))' ELSE ' rate(' || p_type || ') ' END AS q FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace({_PEELED}, '\[\d+[smhd](\d+[smhd])*\]', '', 'g'), '\{{[^}}]*\}}', '', 'g')) AS metric FROM f
""")
def metric_names(t: Tables) -> DataFrame:
    """What is taken for the metric's name in odd texts: deep calls, arithmetic behind or between calls, words between a function and its parenthesis, leading blanks."""
    kind, name = F.col("p_size") % 5, F.col("p_type")
    forms = [('avg without (cpu) (', '{a="1"})'), ("a(b(c(d(e(f(", "[5m])))))) + 1"), ("log2(", '{x="("})'), ("sum(rate(x[1h:5m])) / sum(rate(", "[2m]))"), (" rate(", ") ")]
    q = F.coalesce(*[F.when(kind == k, F.concat(F.lit(a), name, F.lit(b))) for k, (a, b) in enumerate(forms)])
    return t.part.select("p_partkey", promql.metric_name(q).alias("metric"))


_FAMILY = "lower(p_type) || CASE p_partkey % 9 WHEN 8 THEN '_seconds' ELSE '' END"
_LABELS = "'brand=' || p_brand || ',size=' || (p_size % 3)"


@query(f"SELECT {_FAMILY} AS family, {_LABELS} AS labels, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL")
def metric_family_group(t: Tables) -> DataFrame:
    """Query texts grouped by metric family and exact label set, whatever form they have."""
    name = promql.metric_name(F.col("q"))
    return _queries(t).groupBy(text.family(name).alias("family"), promql.label_text(F.col("q")).alias("labels")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query(f"""
    WITH f AS (SELECT DISTINCT {_FAMILY} AS family, p_brand AS brand, p_size % 3 AS size FROM part),
    notes AS (SELECT {_FAMILY} AS family, p_brand AS brand, p_size % 3 AS size, p_partkey AS place, ['root_cause', 'propagation', 'symptom', 'meta'][CAST(p_partkey % 4 + 1 AS INT)] AS layer FROM part WHERE p_size > 45 AND p_partkey % 9 <> 8),
    e AS (SELECT family, brand, size, arg_max(layer, place) AS layer, min(place) AS place FROM notes GROUP BY ALL), n AS (SELECT family, arg_min(layer, place) AS layer FROM e GROUP BY 1)
    SELECT f.family, f.brand || '/' || f.size AS labels, coalesce(e.layer, n.layer, 'unknown') AS layer, CASE coalesce(e.layer, n.layer, 'unknown') WHEN 'root_cause' THEN 0 WHEN 'propagation' THEN 1 WHEN 'symptom' THEN 2 WHEN 'meta' THEN 3 ELSE 99 END AS place
    FROM f LEFT JOIN e ON f.family = e.family AND f.brand = e.brand AND f.size = e.size LEFT JOIN n ON f.family = n.family
""")
def annotated_families(t: Tables) -> DataFrame:
    """Families with the layer that a note gives them: by family and labels, else by family alone; in the layers' order."""
    rows = _queries(t).select("p_partkey", "p_size", text.family(promql.metric_name(F.col("q"))).alias("family"), promql.labels_of(F.col("q")).alias("labels"))
    layer = F.element_at(F.array(*map(F.lit, list(text.LAYERS)[:4])), (F.col("p_partkey") % 4 + 1).cast("int"))
    notes = rows.where("p_size > 45 and p_partkey % 9 <> 8").select("family", "labels", F.col("p_partkey").alias("place"), layer.alias("layer"))
    found = families.annotated(rows.select("family", "labels").distinct(), notes).withColumn("place", text.layer_rank(F.col("layer")))
    return found.orderBy("place", "family").select("family", F.array_join(F.transform("labels", lambda p: p["value"]), "/").alias("labels"), "layer", "place")


@query("""
    WITH v AS (SELECT p_brand AS family, ['root_cause', 'propagation', 'symptom', 'meta', 'unknown'][CAST(p_size % 5 + 1 AS INT)] AS layer, CASE WHEN p_size % 7 > 0 THEN p_partkey END AS onset FROM part WHERE p_type <> 'ECONOMY')
    SELECT family, layer, min(onset) AS onset, count(*) AS n, CASE layer WHEN 'root_cause' THEN 0 WHEN 'propagation' THEN 1 WHEN 'symptom' THEN 2 WHEN 'meta' THEN 3 ELSE 99 END AS place FROM v GROUP BY ALL
""")
def onset_by_layer(t: Tables) -> DataFrame:
    """The earliest known onset of each family in each layer; variants that told nothing are left out."""
    kind = F.when(F.col("p_type") == "ECONOMY", F.lit("Rate (INCONCLUSIVE)")).otherwise(F.lit("rate"))
    layer = F.element_at(F.array(*map(F.lit, text.LAYERS)), (F.col("p_size") % 5 + 1).cast("int"))
    rows = t.part.where(families.conclusive(kind)).select(F.col("p_brand").alias("family"), layer.alias("layer"), F.when(F.col("p_size") % 7 > 0, F.col("p_partkey")).alias("onset"))
    found = rows.groupBy("family", "layer").agg(F.min("onset").alias("onset"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("place", text.layer_rank(F.col("layer"))).orderBy("place", "family")


@query("""
    SELECT c_custkey, starts_with(c_name, 'Customer#') AND c_nationkey % 3 <> 1 AS own, starts_with(c_name, 'Customer#') AND c_nationkey % 3 = 0 AS raw FROM customer
""")
def run_files(t: Tables) -> DataFrame:
    """Files of exactly one flag's runs: another flag's name may begin alike, and derived files lie beside them."""
    tail = F.when(F.col("c_nationkey") % 3 == 1, F.lit("Big-1-a.json")).when(F.col("c_nationkey") % 3 == 2, F.lit("-12-a-labeled.json")).otherwise(F.lit("-12-a.json"))
    flag = F.concat(F.lit("flag"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("metrics-"), flag, tail)
    return t.customer.select("c_custkey", families.run_file(name, flag).alias("own"), families.run_file(name, flag, derived=False).alias("raw"))


_RATE = """
    d AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS rise FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT event_id, user_id, ts, event_type, sum(rise) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE AS rate FROM d)
"""


def _rates(t: Tables) -> DataFrame:
    return promql.rate(t.events, ["user_id"], "ts", "value", 3600, tie="event_id")


@query(f"WITH {_RATE} SELECT event_id, round(rate, 6) AS rate FROM r")
def promql_rate(t: Tables) -> DataFrame:
    """rate(counter[1h]) of each series at each sample."""
    return _rates(t).select("event_id", r6(F.col("rate")).alias("rate"))


@query(f"""
    WITH {_RATE}, g AS (SELECT date_trunc('hour', ts) AS step, event_type, sum(rate) AS total, avg(rate) AS mean FROM r GROUP BY ALL)
    SELECT e.step, round(e.total, 9) AS errors, round(v.mean, 9) AS views, round(CASE WHEN v.mean <> 0 THEN e.total / v.mean END, 4) AS ratio
    FROM g e JOIN g v ON e.step = v.step WHERE e.event_type = 'error' AND v.event_type = 'view'
""")
def promql_sum_avg_ratio(t: Tables) -> DataFrame:
    """sum(rate) of one metric over avg(rate) of another, step by step."""
    g = _rates(t).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("step"), "event_type").agg(F.sum("rate").alias("total"), F.avg("rate").alias("mean"))
    left, right = g.where("event_type = 'error'").select("step", "total"), g.where("event_type = 'view'").select("step", "mean")
    return left.join(right, "step").select("step", F.round("total", 9).alias("errors"), F.round("mean", 9).alias("views"), F.round(F.try_divide("total", "mean"), 4).alias("ratio"))


@query("""
    WITH b AS (SELECT user_id, CAST(ceil(epoch_us(min(ts)) / 21600000000.0) AS BIGINT) AS a, CAST(ceil(epoch_us(max(ts)) / 21600000000.0) AS BIGINT) AS z FROM events GROUP BY 1),
    g AS (SELECT user_id, make_timestamp(unnest(range(a, z + 1)) * 21600000000) AS step FROM b), s AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL)
    SELECT g.user_id, g.step, s.value FROM g ASOF JOIN s ON g.user_id = s.user_id AND s.ts <= g.step
""")
def step_grid_last(t: Tables) -> DataFrame:
    """Series read on a grid of six hours: the last sample at or before each step."""
    return promql.on_grid(t.events.select("user_id", "ts", "value"), ["user_id"], "ts", "value", 21_600)


_SAMPLES = """
    s AS (SELECT event_type AS name, user_id % 4 AS g, user_id AS u, ts, value, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS k FROM events),
    top AS (SELECT max(epoch_us(ts)) // 3600000000 AS z FROM events),
    d AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS rise FROM s WINDOW w AS (PARTITION BY name, u ORDER BY ts, value)),
    x AS (SELECT d.*, k + more AS hr FROM d, (SELECT unnest([0, 1]) AS more), top WHERE k + more <= z),
    r AS (SELECT name, g, u, hr, sum(rise) / 7200.0::DOUBLE AS rate, arg_max(value, (ts, value)) AS last FROM x GROUP BY ALL)
"""
_PROMQL = ["view{g='1',u!~'1.*'}".replace("'", '"'), "sum(rate(error[2h]))", 'avg without (u) (click{g=~"1|2"})', "sum by (g) (rate(error[2h])) / sum by (g) (rate(view[2h]))"]


@query(f"""
    WITH {_SAMPLES}, e AS (SELECT g, hr, sum(rate) AS v FROM r WHERE name = 'error' GROUP BY ALL), w AS (SELECT g, hr, sum(rate) AS v FROM r WHERE name = 'view' GROUP BY ALL),
    out AS (SELECT 0 AS q, 'g=' || g || ',u=' || u AS labels, hr, last AS value FROM r WHERE name = 'view' AND g = 1 AND NOT regexp_full_match(u::VARCHAR, '1.*')
      UNION ALL SELECT 1, '', hr, sum(rate) FROM r WHERE name = 'error' GROUP BY hr UNION ALL SELECT 2, 'g=' || g, hr, avg(last) FROM r WHERE name = 'click' AND g IN (1, 2) GROUP BY g, hr
      UNION ALL SELECT 3, 'g=' || e.g, e.hr, CASE WHEN w.v <> 0 THEN e.v / w.v END FROM e JOIN w ON e.g = w.g AND e.hr = w.hr)
    SELECT q, labels, make_timestamp(hr * 3600000000) AS step, round(value, 9) AS value FROM out
""")
def promql_eval(t: Tables) -> DataFrame:
    """Query texts compiled to plans and evaluated on a grid of hours: matchers, rates, aggregates by and without labels, vector by vector."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    samples = t.events.select(F.col("event_type").alias("name"), F.array(pair("g", F.col("user_id") % 4), pair("u", F.col("user_id"))).alias("labels"), "ts", "value")
    top = int(samples.agg(F.max(micros(F.col("ts")))).first()[0]) // 1_000_000
    shown = F.array_join(F.transform("labels", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    parts = [promql.evaluate(samples, q, 3600, top, 7200).select(F.lit(k).alias("q"), shown.alias("labels"), "step", F.round("value", 9).alias("value")) for k, q in enumerate(_PROMQL)]
    return reduce(DataFrame.unionByName, parts)


@query("""
    WITH inc AS (SELECT user_id, arg_min(ts, event_id) FILTER (event_type = 'signup' AND ts > TIMESTAMP '2024-01-15') AS hit FROM events GROUP BY 1),
    s AS (SELECT user_id, ts, CASE WHEN user_id % 3 = 0 AND ts >= hit THEN 0 WHEN user_id % 3 = 1 AND ts < hit THEN 0 ELSE value * CASE WHEN ts >= hit AND event_type = 'error' THEN 9 ELSE 1 END END AS value, ts < hit AS before FROM events JOIN inc USING (user_id) WHERE hit IS NOT NULL),
    base AS (SELECT user_id, avg(value) FILTER (before) + 3 * coalesce(stddev_samp(value) FILTER (before), 0) AS edge, coalesce(bool_or(before AND value <> 0), false) AS was, max(ts) FILTER (before AND value <> 0) AS last, coalesce(bool_or(NOT before AND value <> 0), false) AS live FROM s GROUP BY 1)
    SELECT user_id, min(ts) FILTER (NOT before AND CASE WHEN was THEN value > edge ELSE value <> 0 END) AS spiked, any_value(CASE WHEN NOT live THEN last END) AS collapsed FROM s JOIN base USING (user_id) GROUP BY 1
""")
def earliest_onset(t: Tables) -> DataFrame:
    """Onsets after each series' incident. Of every three series one ends at it, one begins at it, and errors of the third are nine times as high after it."""
    late = (F.col("event_type") == "signup") & (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz"))
    inc = t.events.groupBy("user_id").agg(F.min_by("ts", F.when(late, F.col("event_id"))).alias("hit")).where("hit is not null")
    after, kind = F.col("ts") >= F.col("hit"), F.col("user_id") % 3
    value = F.when(((kind == 0) & after) | ((kind == 1) & ~after), F.lit(0.0)).otherwise(F.col("value") * F.when(after & (F.col("event_type") == "error"), 9).otherwise(1))
    n = parts_for(t.events)
    series = t.events.select("user_id", "ts", "event_type", "value").repartition(n, "user_id").join(inc.repartition(n, "user_id"), "user_id").select("user_id", "ts", value.alias("value"))
    return onset.onsets(series, inc, ["user_id"], "ts", "value", "hit").select("user_id", "spiked", "collapsed")


@query("""
    WITH s AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
    SELECT event_type, count(*) AS n_series, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(quantile_cont(v, 0.9), 6) AS p90 FROM s GROUP BY 1
""")
def series_extremes(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_series"), r6(F.min("v")).alias("lowest"), r6(F.max("v")).alias("highest"), r6(F.percentile("v", 0.9)).alias("p90"))


@query("""
    SELECT user_id AS series, date_trunc('day', ts) AS step, count(*) AS n FROM events WHERE regexp_full_match(event_type, 'error|view') GROUP BY ALL
""")
def anchored_matcher(t: Tables) -> DataFrame:
    """=~ matchers are anchored at both ends."""
    rows = t.events.where(F.col("event_type").rlike("^(?:error|view)$"))
    return rows.groupBy(F.col("user_id").alias("series"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("step")).agg(F.count(F.lit(1)).alias("n"))
