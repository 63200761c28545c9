"""Trajectory analytics. Stand-ins: a user's day is a step, event types are categories of tool
calls; a conversation is a trial, its turns are calls with their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import stats, trajectory
from quern.plans.registry import Tables, big, query, r6

_STEPS = "steps AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, event_type AS cat FROM events)"
_MOVES = f"""
    {_STEPS}, dense AS (SELECT user_id, cat, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS n FROM steps),
    sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, n) AS k FROM dense),
    moves AS (SELECT a.cat AS prev, b.cat AS next, sum(1.0::DOUBLE / (a.k * b.k)) AS weight FROM sized a JOIN sized b ON a.user_id = b.user_id AND b.n = a.n + 1 GROUP BY ALL)
"""


def _steps(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("cat")).distinct()


def _moves(t: Tables) -> DataFrame:
    return trajectory.transitions(_steps(t), ["user_id"], "day", "cat")


@query(f"WITH {_MOVES} SELECT prev, next, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY prev), 6) AS p FROM moves")
def transition_matrix(t: Tables) -> DataFrame:
    """Row-normalised matrix of weighted moves between consecutive steps' categories."""
    return trajectory.normalised(_moves(t)).select("prev", "next", r6(F.col("weight")).alias("weight"), r6(F.col("p")).alias("p"))


@query(f"WITH {_STEPS}, c AS (SELECT cat, count(*) AS n FROM steps GROUP BY 1) SELECT cat, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM c")
def marginal_share(t: Tables) -> DataFrame:
    """Counts of categories and their shares of the total (a sum over one row per category)."""
    counts = _steps(t).groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query(f"""
    WITH {_MOVES}, m AS (SELECT cat, count(*)::DOUBLE / (SELECT count(*) FROM steps) AS share FROM steps GROUP BY 1),
    p AS (SELECT *, weight / sum(weight) OVER (PARTITION BY prev) AS p FROM moves)
    SELECT prev, next, round(p, 6) AS p, round(share * p, 6) AS flow, round(max(share * p) OVER (), 6) AS largest FROM p JOIN m ON cat = prev WHERE p >= 0.05 AND share * p >= 0.03
""")
def joint_flow_edges(t: Tables) -> DataFrame:
    """Edges of the flow graph worth drawing: probable moves from frequent categories."""
    counts = _steps(t).groupBy(F.col("cat").alias("prev")).agg(F.count(F.lit(1)).alias("n"))
    share = counts.select("prev", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))
    rows = trajectory.normalised(_moves(t)).join(share, "prev").withColumn("flow", F.col("share") * F.col("p"))
    kept = rows.where("p >= 0.05 and flow >= 0.03").withColumn("largest", F.max("flow").over(Window.partitionBy(F.lit(0))))
    return kept.select("prev", "next", *[r6(F.col(c)).alias(c) for c in ("p", "flow", "largest")])


@query("""
    WITH c AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    runs AS (SELECT * FROM c WHERE p IS DISTINCT FROM event_type),
    q AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM runs)
    SELECT user_id, count(*) AS n_runs, count(*) FILTER (before = 'click' AND event_type = 'view') AS click_to_view, count(*) FILTER (before = 'view' AND event_type = 'click') AS view_to_click FROM q GROUP BY 1
""")
def run_length_transitions(t: Tables) -> DataFrame:
    """Switches between two kinds of calls after repeats are collapsed; other kinds in between break them."""
    runs = trajectory.collapsed(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    q = runs.withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    move = lambda a, b: F.count_if((F.col("before") == a) & (F.col("event_type") == b))
    return q.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_runs"), move("click", "view").alias("click_to_view"), move("view", "click").alias("view_to_click"))


@query("""
    SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_category, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'purchase')) AS first_telemetry FROM events GROUP BY 1
""")
def first_category(t: Tables) -> DataFrame:
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.min_by("event_type", order).alias("first_category"), F.min_by("event_type", F.when(F.col("event_type").isin("error", "purchase"), order)).alias("first_telemetry"))


@query("""
    WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    q AS (SELECT event_type, (place >= floor(n / 4))::BIGINT + (place >= floor(2 * n / 4))::BIGINT + (place >= floor(3 * n / 4))::BIGINT AS quarter FROM s)
    SELECT quarter, count(*) AS n_calls, round(count_if(event_type = 'error') / count(*)::DOUBLE, 6) AS density FROM q GROUP BY 1
""")
def quartile_density(t: Tables) -> DataFrame:
    """Share of telemetry calls in each quarter of a run."""
    rows = trajectory.numbered(t.events, ["user_id"], ["ts", "event_id"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return rows.groupBy(big(trajectory.quarter(F.col("pos"), F.col("n"))).alias("quarter")).agg(F.count(F.lit(1)).alias("n_calls"), r6(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("density"))


@query("""
    WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(n) AS lo, max(n) AS hi, median(n) AS mid FROM n)
    SELECT CAST(CASE WHEN n >= hi THEN 20 ELSE floor((n - lo)::DOUBLE * 20 / (hi - lo)) + 1 END AS BIGINT) AS bin, count(*) AS n_trials, round(any_value(mid)::DOUBLE, 6) AS median FROM n, b GROUP BY 1
""")
def calls_histogram(t: Tables) -> DataFrame:
    """Twenty equal bins of calls per trial, the largest value in the last bin."""
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    b = n.select(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi"), F.median("n").alias("mid"))).scalar()
    at = F.floor((F.col("n") - b["lo"]).cast("double") * 20 / (b["hi"] - b["lo"])) + 1
    rows = n.select(big(F.when(F.col("n") >= b["hi"], F.lit(20)).otherwise(at)).alias("bin"), b["mid"].alias("mid"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n_trials"), r6(F.any_value("mid")).alias("median"))


@query("""
    WITH per AS (SELECT user_id, avg((event_type = 'error')::INT) AS f, avg((event_type = 'view')::INT) AS g FROM events WHERE event_type <> 'signup' GROUP BY 1)
    SELECT count(*) AS n, round(avg(f), 6) AS mean, round(stddev_samp(f) / sqrt(count(*)), 6) AS sem, round(sqrt(stddev_samp(f) ** 2 / count(*) + stddev_samp(g) ** 2 / count(*)), 6) AS combined FROM per
""")
def failure_rate_two_level(t: Tables) -> DataFrame:
    """Failure share per trial, then mean and error over trials; errors of two measures in quadrature."""
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("int"))
    per = t.events.where("event_type <> 'signup'").groupBy("user_id").agg(share("error").alias("f"), share("view").alias("g"))
    (n, mean, sem), (_, _, other) = stats.mean_sem(F.col("f")), stats.mean_sem(F.col("g"))
    return per.agg(n.alias("n"), r6(mean).alias("mean"), r6(sem).alias("sem"), r6(stats.in_quadrature(sem, other)).alias("combined"))


@query("""
    WITH w AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
    SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, CAST(sum(n) AS BIGINT) AS n_chars, arg_max(role, turn) AS last_role FROM w GROUP BY 1
""")
def conversation_rollup(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.char_length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role"))


@query("""
    WITH RECURSIVE calls AS (
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS c,
        substr(trim(split_part(CASE WHEN turn % 4 = 3 THEN substr(coalesce(text, ''), 1, 2) ELSE coalesce(text, '') END, chr(10), 1)), 1, 30) AS needle FROM conversations),
    inputs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 3 % 8) - 1 AS k, coalesce(text, '') AS data FROM conversations WHERE turn % 5 <> 2),
    walk AS (
      SELECT conv_id, 0::BIGINT AS c, NULL::BIGINT AS turn, NULL::BIGINT AS place, 0::BIGINT AS free FROM calls GROUP BY 1
      UNION ALL
      SELECT w.conv_id, n.c, n.turn, min(i.k), coalesce(min(i.k) + 1, max(w.free)) FROM walk w JOIN calls n ON n.conv_id = w.conv_id AND n.c = w.c + 1
      LEFT JOIN inputs i ON i.conv_id = w.conv_id AND i.k >= w.free AND n.needle <> '' AND contains(i.data, n.needle) GROUP BY w.conv_id, n.c, n.turn)
    SELECT conv_id, turn, place FROM walk WHERE c > 0
""")
def ordered_alignment(t: Tables) -> DataFrame:
    """Calls placed, in order, at the inputs that contain them. Inputs lie in another order than calls and lack some, and every fourth call has but two letters, so calls are missed and taken by others' inputs."""
    said = F.coalesce("text", F.lit(""))
    short = F.when(F.col("turn") % 4 == 3, F.substring(said, 1, 2)).otherwise(said)
    calls = t.conversations.select("conv_id", F.col("turn").alias("call"), short.alias("command"))
    inputs = t.conversations.where("turn % 5 <> 2").select("conv_id", (F.col("turn") * 3 % 8).alias("at"), said.alias("data"))
    return trajectory.aligned(calls, inputs, "conv_id", "call", "command", "at", "data").select("conv_id", F.col("call").alias("turn"), "place")
