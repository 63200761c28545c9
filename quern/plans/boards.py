"""Leaderboard metrics. Stand-ins: orders are trials (customer: task, price scaled to a reward)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import checks, cost, stats, verdicts
from quern.plans.registry import Tables, big, query, r6

_REWARD = "(o_totalprice::DOUBLE % 1000) / 1000"


def _rewards(t: Tables) -> DataFrame:
    return t.orders.withColumn("reward", stats.checked_reward((F.col("o_totalprice").cast("double") % 1000) / 1000))


# A trial without a verdict has no reward: the stand-in are orders of status P and all orders of customers whose key ends in 7.
_SCORED = f"CASE WHEN o_orderstatus = 'P' OR o_custkey % 10 = 7 THEN NULL ELSE {_REWARD} END"


def _scored(t: Tables) -> DataFrame:
    return _rewards(t).withColumn("reward", F.when((F.col("o_orderstatus") == "P") | (F.col("o_custkey") % 10 == 7), F.lit(None).cast("double")).otherwise(F.col("reward")))


@query(f"""
    WITH trial AS (SELECT o_orderpriority AS grp, o_custkey AS task, {_SCORED} AS reward FROM orders),
    total AS (SELECT grp, avg(reward) AS mean, count(reward) AS n_trials FROM trial GROUP BY grp),
    task AS (SELECT grp, task, avg(reward) AS m, count(reward) AS k, coalesce(var_samp(reward), 0) AS v FROM trial WHERE reward IS NOT NULL GROUP BY ALL),
    err AS (SELECT grp, count(*) AS n_tasks, sqrt(CASE WHEN max(k) >= 2 THEN sum(v / k) / (count(*) * count(*)) ELSE coalesce(var_samp(m), 0) / count(*) END) AS se FROM task GROUP BY grp)
    SELECT grp, n_tasks, n_trials, round(100 * mean, 6) AS mean, round(100 * se, 6) AS se FROM total JOIN err USING (grp)
""")
def lb_metrics_by_group(t: Tables) -> DataFrame:
    """Graded accuracy in percent, over all scored trials, with the two-estimator standard error."""
    found = stats.graded_accuracy(_scored(t).withColumnRenamed("o_orderpriority", "grp"), ["grp"], ["o_custkey"], "reward")
    return found.select("grp", "n_tasks", "n_trials", r6(100 * F.col("mean")).alias("mean"), r6(100 * F.col("se")).alias("se"))


@query(f"""
    SELECT o_orderkey, round(CASE WHEN d.c_custkey IS NOT NULL THEN 0 WHEN c.c_custkey IS NOT NULL THEN 1 ELSE {_REWARD} END, 6) AS reward
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0) d ON d.c_custkey = o_custkey
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = o_custkey
""")
def lb_override_join(t: Tables) -> DataFrame:
    """Disqualified before credited before the verdict."""
    out = t.customer.where("c_mktsegment = 'BUILDING' and c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("disqualified"))
    good = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("credited"))
    rows = _rewards(t).join(out, "o_custkey", "left").join(good, "o_custkey", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("o_orderkey", r6(verdicts.override(flag(F.col("disqualified")), flag(F.col("credited")), F.col("reward"))).alias("reward"))


@query("""
    SELECT c_custkey AS task, 'missing' AS problem FROM customer ANTI JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT o_custkey, 'few' FROM orders GROUP BY o_custkey HAVING count(*) < 5
""")
def lb_coverage_anti(t: Tables) -> DataFrame:
    """Tasks without trials, and tasks with too few."""
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    missing = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("task"), F.lit("missing").alias("problem"))
    return missing.unionByName(per.where("n < 5").select(F.col("o_custkey").alias("task"), F.lit("few").alias("problem")))


# Trials that end without a verdict: a third of the orders of status O broke off. Overrides are by trial.
_COVER = f"""
    trial AS (SELECT o_custkey AS task, {_SCORED} AS reward, o_orderkey % 50 IN (3, 4) AS overridden, CASE o_orderkey % 6 WHEN 0 THEN 'RuntimeError' WHEN 1 THEN 'AgentTimeoutError' END AS error FROM orders),
    n AS (SELECT task, sum((overridden OR reward IS NOT NULL)::INT) AS public, sum((overridden OR reward IS NOT NULL)::INT + (NOT overridden AND reward IS NULL AND coalesce(error, '') <> 'RuntimeError')::INT) AS private FROM trial GROUP BY 1),
    covered AS (SELECT 'public' AS board, task, public AS n FROM n WHERE public > 0 UNION ALL SELECT 'private', task, private FROM n WHERE private > 0)
"""


def _covering(t: Tables) -> DataFrame:
    error = F.when(F.col("o_orderkey") % 6 == 0, "RuntimeError").when(F.col("o_orderkey") % 6 == 1, "AgentTimeoutError")
    rows = _scored(t).withColumn("n_evals", F.when(F.col("reward").isNull(), 0).otherwise(1))
    finished = checks.private_finished(F.lit("board-private"), "board-private", F.col("n_evals"), error)
    return rows.select(F.col("o_custkey").alias("task"), "reward", (F.col("o_orderkey") % 50).isin(3, 4).alias("overridden"), finished.alias("finished"))


@query(f"WITH {_COVER} SELECT board, task, CAST(n AS BIGINT) AS n FROM covered")
def lb_coverage(t: Tables) -> DataFrame:
    """How many trials cover each task on either board: verdicts and overrides, on the private one also what finished without a verdict."""
    both = [checks.coverage(_covering(t), private).select(F.lit("private" if private else "public").alias("board"), "task", "n") for private in (False, True)]
    return both[0].unionByName(both[1])


@query(f"""
    WITH {_COVER}, s AS (SELECT board, count(*) AS tasks, count(*) FILTER (n < 5) AS short FROM covered GROUP BY 1), e AS (SELECT count(DISTINCT o_custkey) AS expected FROM orders)
    SELECT board, CASE WHEN tasks <> expected THEN tasks || ' tasks (expected ' || expected || ')' WHEN short > 0 THEN short || ' task(s) below 5 trials' ELSE '' END AS failure FROM s, e
""")
def coverage_checks(t: Tables) -> DataFrame:
    """Whether each board's submission covers every task often enough, and what is wrong if not."""
    expected = t.orders.select(F.count_distinct("o_custkey")).scalar()
    both = [checks.coverage_failure(checks.coverage(_covering(t), private), expected, 5).select(F.lit("private" if private else "public").alias("board"), "failure") for private in (False, True)]
    return both[0].unionByName(both[1])


@query(f"""
    WITH m AS (SELECT c_nationkey, avg({_REWARD}) AS mean, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_name AS model, n, round(mean, 6) AS mean, CAST(rank() OVER (ORDER BY round(mean, 6) DESC) AS INT) AS rank FROM m JOIN nation ON n_nationkey = c_nationkey
""")
def lb_rank(t: Tables) -> DataFrame:
    per = _rewards(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(r6(F.avg("reward")).alias("mean"), F.count(F.lit(1)).alias("n"))
    rows = per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model"), "n", "mean")
    return stats.ranked(rows, "mean", ["model"]).select("model", "n", "mean", "rank")


@query("""
    SELECT source, count(DISTINCT quality) > 1 AS disagree, list_sort(list(DISTINCT quality)) = [0, 1] AS full_ladder, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def label_agreement(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    return rows.groupBy("source").agg((F.count_distinct("quality") > 1).alias("disagree"), (F.concat_ws(",", F.array_sort(F.collect_set(F.col("quality").cast("string")))) == "0,1").alias("full_ladder"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH e AS (SELECT c_mktsegment AS grp, coalesce(nullif(o_orderstatus, 'O'), 'No error') AS reason, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT grp, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (reason <> 'No error') AS BIGINT) AS bad, (SELECT reason FROM e x WHERE x.grp = e.grp AND reason <> 'No error' ORDER BY n DESC, reason LIMIT 1) AS top_reason FROM e GROUP BY grp
""")
def error_mode_summary(t: Tables) -> DataFrame:
    """Errors per group and the most common reason (by name where tied)."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy(F.col("c_mktsegment").alias("grp"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("No error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("reason") != "No error"
    return per.groupBy("grp").agg(F.sum("n").alias("total"), F.sum(F.when(bad, F.col("n"))).alias("bad"), F.min_by("reason", F.when(bad, F.struct(-F.col("n"), F.col("reason")))).alias("top_reason"))


@query("""
    SELECT c_mktsegment AS agent, o_orderpriority AS model, count(DISTINCT o_orderstatus) AS n_jobs, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS jobs, CAST(max(o_orderdate) AS DATE) AS submitted, count(*) AS n_trials
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def submission_groups(t: Tables) -> DataFrame:
    """Trials by submission key, source jobs once each, the latest date."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    jobs = F.array_sort(F.collect_set("o_orderstatus"))
    return rows.groupBy(F.col("c_mktsegment").alias("agent"), F.col("o_orderpriority").alias("model")).agg(big(F.size(jobs)).alias("n_jobs"), F.array_join(jobs, ",").alias("jobs"), F.to_date(F.max("o_orderdate")).alias("submitted"), F.count(F.lit(1)).alias("n_trials"))


@query("""
    WITH r AS (SELECT l_suppkey, CASE WHEN l_linenumber <= 2 THEN CAST(l_quantity AS BIGINT) END AS tokens_in, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * 3 END AS tokens_out FROM lineitem)
    SELECT l_suppkey, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS n FROM r WHERE tokens_in IS NOT NULL OR tokens_out IS NOT NULL GROUP BY 1
""")
def resource_totals(t: Tables) -> DataFrame:
    """Totals over the rows that report anything; what no row reports stays null."""
    rows = t.lineitem.select("l_suppkey", F.when(F.col("l_linenumber") <= 2, F.col("l_quantity").cast("long")).alias("tokens_in"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long") * 3).alias("tokens_out"))
    return rows.where("tokens_in is not null or tokens_out is not null").groupBy("l_suppkey").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH calls AS (SELECT l_orderkey, p_size % 7 AS s, CAST(round_even(l_extendedprice * 10, 0) AS BIGINT) AS prompt, CAST(l_quantity AS BIGINT) AS completion, CAST(l_quantity * 100 AS BIGINT) AS cached,
      l_linenumber * 10 AS w5, l_linenumber * 20 AS w1, CAST(l_quantity AS BIGINT) * 2 AS thinking, l_returnflag = 'R' AS included FROM lineitem JOIN part ON l_partkey = p_partkey),
    priced AS (SELECT *, prompt > 200000 AS big, CASE WHEN s < 6 THEN 1.0::DOUBLE + s END AS pi, 5.0::DOUBLE + s AS po, CASE WHEN s < 3 THEN 2.0::DOUBLE + s END AS pi2, CASE WHEN s < 3 THEN 9.0::DOUBLE + s END AS po2,
      CASE s WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE END AS read, CASE s WHEN 2 THEN 0.5::DOUBLE END AS read2, CASE s WHEN 3 THEN 0.75::DOUBLE END AS alt, CASE s WHEN 0 THEN 0.0::DOUBLE WHEN 4 THEN 1.25::DOUBLE END AS p5, CASE s WHEN 4 THEN 2.5::DOUBLE END AS p1 FROM calls),
    rates AS (SELECT *, CASE WHEN big THEN coalesce(pi2, pi) ELSE pi END AS ri, CASE WHEN big THEN coalesce(po2, po) ELSE po END AS ro, coalesce(CASE WHEN big THEN coalesce(read2, read) ELSE read END, alt, 0) AS rr FROM priced),
    costs AS (SELECT *, (greatest(prompt - cached - w5 - w1, 0) * ri + cached * rr + w5 * CASE WHEN coalesce(p5, 0) = 0 THEN ri ELSE p5 END + w1 * coalesce(p1, ri) + (completion + CASE WHEN included THEN 0 ELSE thinking END) * ro) / 1000000 AS cost FROM rates)
    SELECT l_orderkey AS trial_id, count(*) AS n_calls, round(CASE WHEN count_if(cost IS NULL) > 0 THEN NULL ELSE sum(cost) END, 9) AS strict_cost, round(sum(cost), 9) AS known_cost FROM costs GROUP BY 1
""")
def token_cost(t: Tables) -> DataFrame:
    """Tiered cost of every call, with cache reads and writes and thinking; totals with and without unknown terms."""
    calls = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    s = F.col("p_size") % 7
    quantity = F.col("l_quantity").cast("long")
    prices = {
        "input": F.when(s < 6, 1.0 + s),
        "output": 5.0 + s,
        "input_over_200k": F.when(s < 3, 2.0 + s),
        "output_over_200k": F.when(s < 3, 9.0 + s),
        "context_cache_read": F.when(s == 0, 0.0).when(s == 2, 0.25),
        "context_cache_read_over_200k": F.when(s == 2, 0.5),
        "cached_input": F.when(s == 3, 0.75),
        "cache_creation_5m": F.when(s == 0, 0.0).when(s == 4, 1.25),
        "cache_creation_1h": F.when(s == 4, 2.5),
    }
    price = cost.token_cost(F.rint(F.col("l_extendedprice") * 10).cast("long"), quantity, prices, (F.col("l_quantity") * 100).cast("long"), F.col("l_linenumber") * 10, F.col("l_linenumber") * 20, quantity * 2, F.col("l_returnflag") == "R")
    return calls.select(F.col("l_orderkey").alias("trial_id"), price.alias("cost")).groupBy("trial_id").agg(F.count(F.lit(1)).alias("n_calls"), F.round(cost.strict_sum(F.col("cost")), 9).alias("strict_cost"), F.round(F.sum("cost"), 9).alias("known_cost"))


@query("""
    SELECT c_custkey, n_name AS display, r_name AS provider FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0
""")
def display_names(t: Tables) -> DataFrame:
    """Lookups in dimension tables of fixed size (25 and 5 rows)."""
    return t.customer.where("c_acctbal > 0").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("display"), F.col("r_name").alias("provider"))
