"""Verdict roll-ups and accuracy tables.

Stand-ins: an order is a trial (customer: task, priority: difficulty, status: mode), a line
item one of its rubrics (flags as nullable verdicts, quantity modulo 4 as score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import stats, verdicts
from quern.plans.registry import Tables, big, parts_for, query, r6

_RUBRICS = """
    rubrics AS (SELECT l_orderkey AS trial_id, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS flag_match,
      CASE l_linestatus WHEN 'O' THEN true WHEN 'F' THEN false END AS mechanism_match, CAST(l_quantity AS BIGINT) % 4 AS score FROM lineitem)
"""


def _rubrics(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("trial_id"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("flag_match"),
        F.when(F.col("l_linestatus") == "O", True).when(F.col("l_linestatus") == "F", False).alias("mechanism_match"),
        (F.col("l_quantity").cast("long") % 4).alias("score"),
    )


@query(f"""
    WITH {_RUBRICS}
    SELECT o_orderkey AS trial_id, bool_or(flag_match) AS any_flag, bool_and(flag_match) AS all_flag, bool_or(mechanism_match) AS any_mechanism, bool_and(mechanism_match) AS all_mechanism
    FROM orders LEFT JOIN rubrics ON o_orderkey = trial_id GROUP BY 1
""")
def rubric_rollup(t: Tables) -> DataFrame:
    """any and every over nullable verdicts; a trial without rubrics stays, with nulls."""
    per = _rubrics(t).groupBy("trial_id").agg(
        verdicts.any_of(F.col("flag_match")).alias("any_flag"),
        verdicts.all_of(F.col("flag_match")).alias("all_flag"),
        verdicts.any_of(F.col("mechanism_match")).alias("any_mechanism"),
        verdicts.all_of(F.col("mechanism_match")).alias("all_mechanism"),
    )
    return t.orders.select(F.col("o_orderkey").alias("trial_id")).join(per, "trial_id", "left")


_TRIALS = f"""
    {_RUBRICS}, per AS (SELECT trial_id, count(*) AS n_rubrics, bool_or(flag_match) AS any_match, coalesce(bool_and(flag_match), false) AS rca_accuracy,
      coalesce(bool_or(mechanism_match), false) AS mechanism, avg(score) AS depth FROM rubrics GROUP BY 1),
    trials AS (SELECT o_orderkey AS trial_id, o_custkey AS task, o_orderpriority AS tier, o_orderstatus AS mode, coalesce(rca_accuracy, false) AS rca_accuracy, coalesce(mechanism, false) AS mechanism,
      CASE WHEN n_rubrics = 1 AND o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' AND n_rubrics = 2 THEN false ELSE NOT coalesce(any_match, false) END AS hallucinate_any,
      depth, coalesce(depth, 0) / 3 AS reward FROM orders LEFT JOIN per ON o_orderkey = trial_id)
"""


def _trials(t: Tables) -> DataFrame:
    per = _rubrics(t).groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("n_rubrics"),
        verdicts.any_of(F.col("flag_match")).alias("any_match"),
        verdicts.all_or_false(F.col("flag_match")).alias("rca_accuracy"),
        verdicts.any_or_false(F.col("mechanism_match")).alias("mechanism"),
        F.avg("score").alias("depth"),
    )
    rows = t.orders.select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("mode")).join(per, "trial_id", "left")
    # Stand-ins for the two special cases: status P has no incident, two rubrics of status F come from an empty report.
    flag = F.when(F.col("mode") == "P", F.lit(verdicts.NO_INCIDENT))
    mode = F.when((F.col("mode") == "F") & (F.col("n_rubrics") == 2), F.lit(verdicts.EMPTY_REPORT)).otherwise(F.lit("judged"))
    false = F.lit(False)
    return rows.select(
        "trial_id", "task", "tier", "mode",
        F.coalesce("rca_accuracy", false).alias("rca_accuracy"),
        F.coalesce("mechanism", false).alias("mechanism"),
        verdicts.hallucinated(mode, F.coalesce("n_rubrics", F.lit(0)), F.coalesce(flag, F.lit("flag")), F.col("any_match")).alias("hallucinate_any"),
        "depth",
        verdicts.reward(F.col("depth")).alias("reward"),
    )


@query(f"""
    WITH {_TRIALS} SELECT trial_id, rca_accuracy, mechanism, hallucinate_any, round(depth, 6) AS depth, round(reward, 6) AS reward FROM trials
""")
def trial_rollup(t: Tables) -> DataFrame:
    return _trials(t).select("trial_id", "rca_accuracy", "mechanism", "hallucinate_any", r6(F.col("depth")).alias("depth"), r6(F.col("reward")).alias("reward"))


_MEASURES = {"rca": "rca_accuracy", "halluc": "hallucinate_any", "mech": "mechanism"}


def _accuracy_columns() -> list:
    out = []
    for name, column in _MEASURES.items():
        n, mean, sem = stats.mean_sem(F.col(column).cast("int") * 100.0)
        out += [n.alias(f"n_{name}"), r6(mean).alias(f"{name}_mean"), r6(sem).alias(f"{name}_sem")]
    return out


_ACCURACY_SQL = ", ".join(f"count({c}) AS n_{k}, round(avg({c}::INT * 100.0::DOUBLE), 6) AS {k}_mean, round(stddev_samp({c}::INT * 100.0::DOUBLE) / sqrt(count({c})), 6) AS {k}_sem" for k, c in _MEASURES.items())


@query(f"""
    WITH {_TRIALS} SELECT c_mktsegment AS agent, mode = 'P' AS is_control, count(*) AS n, round(avg(depth), 6) AS depth_mean, {_ACCURACY_SQL}
    FROM trials JOIN customer ON task = c_custkey GROUP BY ALL
""")
def accuracy_table(t: Tables) -> DataFrame:
    """One row per agent and kind of task: trials, mean and standard error of each measure."""
    rows = _trials(t).join(t.customer.select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("agent")), "task")
    return rows.groupBy("agent", (F.col("mode") == "P").alias("is_control")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("depth")).alias("depth_mean"), *_accuracy_columns())


@query(f"""
    WITH {_TRIALS} SELECT c_mktsegment AS agent, tier, count(*) AS n, round(100.0::DOUBLE * count_if(coalesce(depth, 0) = 0) / count(*), 6) AS pct_zero, {_ACCURACY_SQL}
    FROM trials JOIN customer ON task = c_custkey WHERE mode <> 'P' GROUP BY ALL
""")
def accuracy_by_tier(t: Tables) -> DataFrame:
    rows = _trials(t).where("mode <> 'P'").join(t.customer.select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("agent")), "task")
    zero = F.count_if(F.coalesce("depth", F.lit(0.0)) == 0)
    return rows.groupBy("agent", "tier").agg(F.count(F.lit(1)).alias("n"), r6(100.0 * zero / F.count(F.lit(1))).alias("pct_zero"), *_accuracy_columns())


@query(f"""
    WITH {_TRIALS}, s AS (SELECT c_nationkey, count(*) AS n, avg(reward) AS mean, stddev_samp(reward) / sqrt(count(*)) AS sem FROM trials JOIN customer ON task = c_custkey WHERE tier LIKE '1%' AND mode = 'P' GROUP BY 1)
    SELECT n_name AS model, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(coalesce(sem, 0), 6) AS sem FROM nation LEFT JOIN s ON c_nationkey = n_nationkey
""")
def model_bars(t: Tables) -> DataFrame:
    """Every model has a bar; those without trials are 0."""
    rows = _trials(t).where("tier like '1%' and mode = 'P'").join(t.customer.select(F.col("c_custkey").alias("task"), "c_nationkey"), "task")
    n, mean, sem = stats.mean_sem(F.col("reward"))
    per = rows.groupBy("c_nationkey").agg(n.alias("n"), mean.alias("mean"), sem.alias("sem"))
    mean, sem = stats.zero_filled(F.col("mean"), F.col("sem"))
    return t.nation.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("model"), F.coalesce("n", F.lit(0)).alias("n"), r6(mean).alias("mean"), r6(sem).alias("sem"))


@query(f"""
    WITH {_TRIALS} SELECT c_mktsegment AS model,
      round(avg(rca_accuracy::INT) FILTER (tier LIKE '3%'), 6) AS medium_rca, round(avg(rca_accuracy::INT) FILTER (tier LIKE '1%'), 6) AS hard_rca, round(avg(hallucinate_any::INT), 6) AS hallucination
    FROM trials JOIN customer ON task = c_custkey WHERE mode <> 'P' GROUP BY 1
""")
def figure_panels(t: Tables) -> DataFrame:
    """Three panels of one figure by conditional aggregates in one pass."""
    rows = _trials(t).where("mode <> 'P'").join(t.customer.select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("model")), "task")
    rca = F.col("rca_accuracy").cast("int")
    return rows.groupBy("model").agg(r6(F.avg(F.when(F.col("tier").like("3%"), rca))).alias("medium_rca"), r6(F.avg(F.when(F.col("tier").like("1%"), rca))).alias("hard_rca"), r6(F.avg(F.col("hallucinate_any").cast("int"))).alias("hallucination"))


@query("""
    SELECT d.doc_id, CASE WHEN CASE WHEN l.toxic = 1 THEN NOT regexp_matches(coalesce(d.text, ''), '[^ \t\n\r]') ELSE contains(lower(coalesce(d.text, '')), lower(trim(d.source))) OR contains(lower(coalesce(d.text, '')), 'licensed under') END THEN 3 ELSE 0 END AS score
    FROM documents d JOIN labels l USING (doc_id)
""")
def string_match_score(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    named = verdicts.string_match_score(F.col("text"), F.col("source"), F.col("toxic") == 1)
    phrase = verdicts.string_match_score(F.col("text"), F.lit(" licensed under "), F.col("toxic") == 1)
    return rows.select("doc_id", F.greatest(named, phrase).alias("score"))


@query(f"""
    WITH {_RUBRICS}, types AS (SELECT trial_id, 'flag' AS kind, flag_match AS hit FROM rubrics UNION ALL SELECT trial_id, 'mechanism', mechanism_match FROM rubrics),
    per AS (SELECT trial_id, kind, bool_or(hit) AS hit FROM types GROUP BY ALL)
    SELECT kind, count(*) AS n_trials, count(hit) AS n_judged, round(avg(hit::INT), 6) AS rate FROM per GROUP BY kind
""")
def type_match_rate(t: Tables) -> DataFrame:
    """Share of trials with any match, by type: columns turned into rows, then two levels."""
    kinds = F.array(F.struct(F.lit("flag").alias("kind"), F.col("flag_match").alias("hit")), F.struct(F.lit("mechanism").alias("kind"), F.col("mechanism_match").alias("hit")))
    per = _rubrics(t).select("trial_id", F.explode(kinds).alias("x")).groupBy("trial_id", "x.kind").agg(F.bool_or("x.hit").alias("hit"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("n_trials"), F.count("hit").alias("n_judged"), r6(F.avg(F.col("hit").cast("int"))).alias("rate"))


@query("""
    SELECT o_orderkey AS trial_id, count(*) AS n_calls, count(DISTINCT l_suppkey) AS n_steps, round(date_diff('microsecond', min(o_orderdate), max(l_shipdate)) / 60000000.0::DOUBLE, 6) AS minutes
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def durations(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate")
    n = parts_for(items)
    rows = t.orders.select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey").join(items.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.groupBy(F.col("o_orderkey").alias("trial_id")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("l_suppkey").alias("n_steps"), r6((us(F.max("l_shipdate")) - us(F.min("o_orderdate"))) / 6e7).alias("minutes"))


# Trials are customers, records those of their orders that tell what was used; trials are counted apart, but for every fifth nation.
_USED = """
    r AS (SELECT c_mktsegment, c_nationkey, c_custkey AS trial, o_totalprice AS tokens, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS thinking FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
    told AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 > 0 GROUP BY ALL),
    s AS (SELECT c_mktsegment, c_nationkey, count(*) AS n_records, sum(tokens / 1e6::DOUBLE) AS t, sum((tokens / 1e6::DOUBLE) * (tokens / 1e6::DOUBLE)) AS tt, sum(coalesce(thinking, 0)::DOUBLE) AS k, sum(coalesce(thinking, 0)::DOUBLE * coalesce(thinking, 0)) AS kk FROM r GROUP BY ALL),
    p AS (SELECT s.*, coalesce(told.n, n_records) AS n_trials FROM s LEFT JOIN told USING (c_mktsegment, c_nationkey))
"""


@query(f"""
    WITH {_USED} SELECT c_mktsegment, c_nationkey, n_records, n_trials, round(t / n_trials, 6) AS tokens, round(CASE WHEN n_trials > 1 THEN sqrt(greatest(tt - n_trials * (t / n_trials) * (t / n_trials), 0) / (n_trials - 1)) / sqrt(n_trials) ELSE 0 END, 5) AS tokens_sem,
      round(k / n_trials, 6) AS thinking, round(CASE WHEN n_trials > 1 THEN sqrt(greatest(kk - n_trials * (k / n_trials) * (k / n_trials), 0) / (n_trials - 1)) / sqrt(n_trials) ELSE 0 END, 5) AS thinking_sem FROM p
""")
def token_statistics(t: Tables) -> DataFrame:
    """Tokens in millions per group, over trials that were counted elsewhere where they were, missing ones as zeros."""
    every = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    thinking = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 100)
    records = every.where("o_orderstatus = 'F'").select("c_mktsegment", "c_nationkey", "c_custkey", "o_totalprice", thinking.alias("used"))
    told = every.where("c_nationkey % 5 > 0").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n_trials"))
    measures = {"tokens": F.col("o_totalprice").cast("double") / 1e6, "thinking": F.col("used")}
    found = stats.padded_by_group(records, ["c_mktsegment", "c_nationkey"], "c_custkey", measures, told)
    cell = lambda c, digits: F.round(c, digits).alias(c)
    return found.select("c_mktsegment", "c_nationkey", "n_records", "n_trials", cell("tokens", 6), cell("tokens_sem", 5), cell("thinking", 6), cell("thinking_sem", 5))


@query("""
    WITH s AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS total, coalesce(sum(o_totalprice * o_totalprice), 0) AS squares FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_custkey, n, round(total / 20, 6) AS mean, round(sqrt(greatest(squares - 20 * (total / 20) * (total / 20), 0) / 19) / sqrt(20), 4) AS sem FROM s
""")
def padded_stats(t: Tables) -> DataFrame:
    """Mean and error over 20 trials, the missing ones zero."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("total"), F.sum(F.col("o_totalprice") * F.col("o_totalprice")).cast("double").alias("squares"))
    rows = t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0)
    mean, sem = stats.padded_mean_sem(F.col("total"), F.col("squares"), F.lit(20.0))
    return rows.select("c_custkey", "n", r6(mean).alias("mean"), F.round(sem, 4).alias("sem"))
