"""Dataset splits and their checks. Stand-ins: customers are incidents, priorities strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import split
from quern.plans.registry import Tables, query, r6


_FOLD = """
    pins AS (SELECT c_custkey AS incident FROM customer WHERE c_acctbal > 9800),
    g AS (SELECT o_orderstatus AS stratum, o_custkey AS incident, count(*) AS n, o_custkey IN (SELECT incident FROM pins) AS pinned FROM orders GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || incident), incident) AS rn FROM g WHERE NOT pinned),
    s AS (SELECT stratum, 0.7::DOUBLE * sum(n) AS target, coalesce(sum(n) FILTER (pinned), 0)::BIGINT AS held FROM g GROUP BY 1),
    f AS (SELECT stratum, target, 0::BIGINT AS rn, held, NULL::BIGINT AS incident, false AS take FROM s
      UNION ALL SELECT f.stratum, f.target, o.rn, CASE WHEN abs(f.held + o.n - f.target) < abs(f.held - f.target) THEN f.held + o.n ELSE f.held END, o.incident, abs(f.held + o.n - f.target) < abs(f.held - f.target) FROM f JOIN o ON o.stratum = f.stratum AND o.rn = f.rn + 1),
    sides AS (SELECT g.stratum, g.incident, n AS n_tasks, pinned, CASE WHEN pinned OR take THEN 'public' ELSE 'private' END AS side FROM g LEFT JOIN f ON f.stratum = g.stratum AND f.incident = g.incident)
"""


def _pins(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9800").select(F.col("c_custkey").alias("incident"))


def _tasks(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderstatus").alias("stratum"), F.col("o_custkey").alias("incident"), F.col("o_orderkey").alias("task"))


def _assigned(t: Tables) -> DataFrame:
    return split.assigned(_tasks(t), "stratum", "incident", 0.7, 7, _pins(t))


@query(f"WITH RECURSIVE {_FOLD} SELECT * FROM sides")
def split_assign(t: Tables) -> DataFrame:
    """The public side of each stratum: verified incidents, then others in drawn order while the share gets nearer to 0.7."""
    return _assigned(t)


@query(f"""
    WITH RECURSIVE {_FOLD} SELECT 'both sides' AS check_name, (SELECT count(*) FROM (SELECT stratum, incident FROM sides WHERE side = 'public' INTERSECT SELECT stratum, incident FROM sides WHERE side = 'private')) AS n
    UNION ALL SELECT 'neither side', (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders EXCEPT SELECT stratum, incident FROM sides))
    UNION ALL SELECT 'pins outside', (SELECT count(*) FROM (SELECT stratum, incident FROM g WHERE incident IN (SELECT incident FROM pins) EXCEPT SELECT stratum, incident FROM sides WHERE side = 'public'))
    UNION ALL SELECT 'public', (SELECT count(*) FROM sides WHERE side = 'public')
""")
def split_checks(t: Tables) -> DataFrame:
    """Disjoint, complete, and the verified incidents on the public side, by set operations."""
    sides = _assigned(t)
    keys = ["stratum", "incident"]
    public, private = sides.where("side = 'public'").select(*keys), sides.where("side = 'private'").select(*keys)
    every = _tasks(t).select(*keys).distinct()
    pins = every.join(_pins(t), "incident", "left_semi").select(*keys)
    both = public.union(private)
    found = [("both sides", public.intersect(private)), ("neither side", every.exceptAll(both).union(both.exceptAll(every))), ("pins outside", pins.subtract(public)), ("public", public)]
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n") for name, rows in found])


@query(f"""
    WITH RECURSIVE {_FOLD} SELECT o_orderstatus AS stratum, side AS split, is_verified, side = 'private' AS is_hidden_view, count(*) AS n_tasks, count(DISTINCT o_custkey) AS n_incidents
    FROM (SELECT *, pinned AND side = 'public' AS is_verified FROM orders JOIN sides ON stratum = o_orderstatus AND incident = o_custkey WHERE o_orderstatus IN ('O', 'F')) GROUP BY ALL
""")
def split_views(t: Tables) -> DataFrame:
    """The published strata as disjoint splits with the views that overlap them, counted."""
    rows = split.orchestrated(_tasks(t), "stratum", "incident", "task", ["O", "F"], 0.7, 7, _pins(t).join(_tasks(t).where("stratum <> 'P'"), "incident", "left_semi"))
    return rows.groupBy("stratum", "split", "is_verified", "is_hidden_view").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("incident").alias("n_incidents"))


@query("""
    SELECT coalesce(o_orderpriority, 'TOTAL') AS stratum, count(DISTINCT o_custkey) AS n_incidents, count(*) AS n_tasks, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS fraction FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def rollup_totals(t: Tables) -> DataFrame:
    """Incidents and tasks per stratum with a total row."""
    total = t.orders.select(F.count(F.lit(1))).scalar()
    return t.orders.rollup("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_incidents"), F.count(F.lit(1)).alias("n_tasks"), r6(F.count(F.lit(1)) / total).alias("fraction")).select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("stratum"), "n_incidents", "n_tasks", "fraction")


@query("""
    SELECT o_custkey AS event, o_orderpriority AS granularity, arg_min(o_orderkey, (md5('11:' || o_orderkey), o_orderkey)) AS picked FROM orders GROUP BY ALL
""")
def seeded_pick(t: Tables) -> DataFrame:
    """One question per event and granularity: the one that a seeded draw puts first."""
    return t.orders.groupBy(F.col("o_custkey").alias("event"), F.col("o_orderpriority").alias("granularity")).agg(F.min_by("o_orderkey", F.struct(split.draw(11, F.col("o_orderkey")), "o_orderkey")).alias("picked"))


@query("""
    SELECT o_custkey AS incident, o_orderkey AS task FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) v ON v.c_custkey = o_custkey
""")
def verified_semi(t: Tables) -> DataFrame:
    """Tasks of verified incidents; a verified incident that was not built would stop the job."""
    built = t.orders.select(F.col("o_custkey").alias("incident")).distinct()
    good = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("incident"))
    return split.complete(t.orders.select(F.col("o_custkey").alias("incident"), F.col("o_orderkey").alias("task")), good.join(built, "incident", "left_semi"), "incident")
