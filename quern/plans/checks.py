"""Submissions to a leaderboard: which trials belong, checks of configurations, what is published.

Stand-ins: an order is a trial, a customer its task, a nation a submission; settings follow
from remainders of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text, times
from quern.operators import checks, ordering, verdicts
from quern.plans.registry import Tables, big, query, r6
from quern.plans.trees import _cat, _files
from quern.sources import sinks, trees


def _o() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


_HUB = """
    trial AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'bench/open' WHEN 'F' THEN 'bench/closed' ELSE 'other' END AS source, 'a' || (o_custkey % 3) AS agent, 'v' || (o_orderkey % 2) AS version,
      CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'p' || (o_custkey % 4) END AS provider, 'm' || (o_custkey % 5) AS model FROM orders),
    joined AS (SELECT *, CASE WHEN coalesce(provider, 'unknown') = 'unknown' THEN model ELSE provider || '/' || model END AS full_model FROM trial)
"""


def _hub(t: Tables) -> DataFrame:
    source = F.when(F.col("o_orderstatus") == "O", "bench/open").when(F.col("o_orderstatus") == "F", "bench/closed").otherwise("other")
    provider = F.when(_c() % 4 == 1, F.lit("unknown")).when(_c() % 4 > 1, _cat("p", _c() % 4))
    return t.orders.select("*", source.alias("source"), _cat("a", _c() % 3).alias("agent"), _cat("v", _o() % 2).alias("version"), provider.alias("provider"), _cat("m", _c() % 5).alias("model"))


_SUBMISSIONS = """
    sub AS (SELECT n_nationkey AS submission, CASE n_nationkey % 3 WHEN 2 THEN 'bench/closed' ELSE 'bench/open' END AS dataset, 'a' || (n_nationkey % 3) AS agent, 'v' || (n_nationkey % 2) AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'm' || (n_nationkey % 5) ELSE 'p' || (n_nationkey % 4) || '/m' || (n_nationkey % 5) END AS model FROM nation)
"""


def _submissions(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    board = F.when(n % 3 == 1, F.lit("public")).when(n % 3 == 2, F.lit("private"))
    model = F.when(n % 2 == 0, _cat("m", n % 5)).otherwise(_cat("p", n % 4, "/m", n % 5))
    rows = t.nation.select(n.alias("submission"), board.alias("board"), _cat("a", n % 3).alias("agent"), _cat("v", n % 2).alias("version"), model.alias("model"))
    boards = t.spark.range(1).select(F.inline(F.array(F.struct(F.lit("public").alias("board"), F.lit("bench/open").alias("dataset")), F.struct(F.lit("private").alias("board"), F.lit("bench/closed").alias("dataset")))))
    return checks.routed(rows, boards)


@query(f"""
    WITH {_HUB}, {_SUBMISSIONS} SELECT s.submission, count(*) AS n_trials, count(DISTINCT o_custkey) AS n_tasks, min(o_orderkey) AS first
    FROM joined j JOIN sub s ON j.source = s.dataset AND j.agent = s.agent AND j.version = s.version AND j.full_model = s.model GROUP BY 1
""")
def submission_scope(t: Tables) -> DataFrame:
    """Trials of each submission: its board's dataset, agent, version and model must all be equal."""
    found = checks.submission_trials(_hub(t), _submissions(t))
    return found.groupBy("submission").agg(F.count(F.lit(1)).alias("n_trials"), F.count_distinct("o_custkey").alias("n_tasks"), F.min("o_orderkey").alias("first"))


@query("""
    WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN 'timeout_multiplier=2.0,' ELSE '' END || CASE WHEN o_orderkey % 10 = 3 THEN 'agent_timeout_multiplier=3,' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN 'agent.override_timeout_sec=60,' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN 'environment.override_cpus=8,' ELSE '' END AS f,
      CASE o_orderkey % 5 WHEN 0 THEN 'did not run bench' WHEN 1 THEN 'ref mismatch' ELSE '' END AS d FROM orders)
    SELECT o_orderkey, rtrim(f, ',') AS failures, d AS dataset FROM s
""")
def config_checks(t: Tables) -> DataFrame:
    """What is wrong with each run's configuration: multipliers, forbidden settings, datasets."""
    value = lambda hit, x: F.when(hit, F.lit(x))
    config = F.create_map(
        F.lit("agent_timeout_multiplier"), value(_o() % 10 == 3, "3"), F.lit("environment.override_cpus"), value(_o() % 11 == 0, "8"),
        F.lit("agent.override_timeout_sec"), value(_o() % 7 == 0, "60"), F.lit("agent.name"), F.lit("x"),
    )
    multiplier = F.when(_o() % 6 == 2, F.lit(2.0)).when(_o() % 6 == 1, F.lit(1.0))
    entry = lambda name, ref: F.struct(F.lit(name).alias("name"), F.lit(ref).cast("string").alias("ref"))
    sets = F.when(_o() % 5 == 0, F.array(entry("else", "r1"))).when(_o() % 5 == 1, F.array(entry("bench", "r0"), entry("else", "r1"))).when(_o() % 5 == 2, F.array(entry("bench", "r1"))).otherwise(F.array(entry("bench", None)))
    return t.orders.select("o_orderkey", F.array_join(checks.config_failures(multiplier, config), ",").alias("failures"), checks.dataset_failure(sets, F.lit("bench"), F.lit("r1")).alias("dataset"))


_DIGESTS = """
    d AS (SELECT o_orderkey, o_orderpriority AS grp, CASE WHEN c_acctbal < 0 THEN 'task' || (o_custkey % 50) || ' not in dataset' WHEN o_orderkey % 9 = 0 THEN 'task' || (o_custkey % 50) || ' ref mismatch' ELSE '' END AS why FROM orders JOIN customer ON c_custkey = o_custkey % 50)
"""


def _digests(t: Tables) -> DataFrame:
    task = _cat("task", _c() % 50)
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("grp"), task.alias("task"), F.when(_o() % 9 == 0, F.lit("bad")).otherwise(_cat("ref", _c() % 50)).alias("ref"))
    known = t.customer.where("c_acctbal >= 0").select(_cat("task", F.col("c_custkey")).alias("task"), _cat("ref", F.col("c_custkey")).alias("ref"))
    return checks.digest_failures(rows, known)


@query(f"WITH {_DIGESTS} SELECT o_orderkey, why AS digest_failure FROM d")
def digest_checks(t: Tables) -> DataFrame:
    """Each trial's task by its digest: unknown, another version, or right."""
    return _digests(t).select("o_orderkey", "digest_failure")


@query(f"""
    WITH {_DIGESTS}, n AS (SELECT grp, why, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT grp, sum(n) AS total, coalesce(sum(n) FILTER (why <> ''), 0) AS bad, arg_min(why, (-n, why)) FILTER (why <> '') AS top FROM n GROUP BY 1)
    SELECT grp, CAST(bad AS BIGINT) AS bad, CASE WHEN bad > 0 THEN bad || '/' || total || ' bad (' || top || ')' ELSE '' END AS summary FROM s
""")
def check_summary(t: Tables) -> DataFrame:
    """Failures of a group in one line, with the most common reason."""
    return checks.summary(_digests(t), ["grp"], "digest_failure")


@query("""
    SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 5 IN (0, 1, 2) AS waiting, o_orderkey % 5 = 4 AS again FROM orders
""")
def unjudged_trials(t: Tables) -> DataFrame:
    """Private trials that ended and wait for a verdict, and errors worth another attempt."""
    source = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    evals, reward = F.when(_o() % 4 > 0, F.lit("{}")), F.when(_o() % 3 == 1, F.lit(0.5))
    error = F.when(_o() % 5 == 1, "AgentTimeoutError").when(_o() % 5 == 2, "NonZeroAgentExitCodeError").when(_o() % 5 == 3, "PermissionDeniedError").when(_o() % 5 == 4, "RateLimitError")
    return t.orders.select("o_orderkey", checks.finished_unjudged(source, "closed", evals, reward, error).alias("waiting"), checks.retryable(F.coalesce(error, F.lit(""))).alias("again"))


_LABELLED = """
    l AS (SELECT c_custkey AS task, ['easy', 'medium', 'hard'][CAST(c_custkey % 3 + 1 AS INT)] AS difficulty, c_nationkey % 5 = 0 AS is_control FROM customer),
    tr AS (SELECT o_orderpriority AS grp, o_custkey AS task, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 2 END::DOUBLE AS rca, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 3 = 0)::INT END::DOUBLE AS hall, difficulty FROM orders JOIN l ON task = o_custkey WHERE NOT is_control),
    m AS (SELECT grp, task, 'rca_accuracy_incident_medium' AS key, rca AS v FROM tr WHERE difficulty = 'medium' UNION ALL SELECT grp, task, 'rca_accuracy_incident_hard', rca FROM tr WHERE difficulty = 'hard' UNION ALL SELECT grp, task, 'hallucinate_any_incident', hall FROM tr),
    mt AS (SELECT grp, key, task, avg(v) AS m, count(v) AS k, coalesce(var_samp(v), 0) AS s FROM m WHERE v IS NOT NULL GROUP BY ALL)
"""


@query(f"""
    WITH {_LABELLED}, e AS (SELECT grp, key, sqrt(CASE WHEN max(k) >= 2 THEN sum(s / k) / (count(*) * count(*)) ELSE coalesce(var_samp(m), 0) / count(*) END) AS se FROM mt GROUP BY ALL), a AS (SELECT grp, key, avg(v) AS mean, count(v) AS n FROM m GROUP BY ALL)
    SELECT grp, key, round(100 * mean, 2) AS mean, round(100 * se, 2) AS se, n FROM a JOIN e USING (grp, key)
""")
def published_metrics(t: Tables) -> DataFrame:
    """The published metrics of each submission over their subsets of incident tasks, with errors and counts."""
    c = F.col("c_custkey")
    labels = t.customer.select(c.alias("task"), F.element_at(F.array(*map(F.lit, ["easy", "medium", "hard"])), (c % 3 + 1).cast("int")).alias("difficulty"), (F.col("c_nationkey") % 5 == 0).alias("is_control"))
    trials = t.orders.select(F.col("o_orderpriority").alias("grp"), _c().alias("task"), F.when(F.col("o_orderstatus") != "P", _o() % 2).cast("double").alias("rca_accuracy"), F.when(_o() % 7 > 0, (_o() % 3 == 0).cast("int")).cast("double").alias("hallucinate_any"))
    return checks.published(checks.labelled(trials, labels), ["grp"])


@query("""
    WITH e AS (SELECT event_id AS k FROM events)
    SELECT k, CASE k % 4 WHEN 3 THEN NULL ELSE round(k % 11 / 10.0, 6)::DOUBLE END AS reward, CASE k % 4 WHEN 3 THEN NULL ELSE (k % 2)::DOUBLE END AS rca FROM e
""")
def named_metrics(t: Tables) -> DataFrame:
    """Metrics read by name from evaluations of either shape; trials without evaluations have none."""
    k = F.col("event_id")
    reward, rca = (F.round(k % 11 / 10, 1)).cast("string"), (k % 2).cast("string")
    nested = _cat('{"aaa":{"metrics":[{"aaa":7}]},"reward":{"metrics":[{"reward":', reward, '}]},"rca_accuracy":{"metrics":[{"rca_accuracy":', rca, "}]}}")
    listed = _cat('{"group_by":["x"],"rows":[{"metrics":[{"aaa":7},{"rca_accuracy":', rca, '}]},{"metrics":[{"reward":', reward, "}]}]}")
    evals = F.when(k % 4 == 0, nested).when(k % 4 == 3, F.when(k % 8 == 3, F.lit("{}"))).otherwise(listed)
    return t.events.select(k.alias("k"), trees.named_metric(evals, "reward").alias("reward"), trees.named_metric(evals, "rca_accuracy").alias("rca"))


@query("""
    SELECT o_orderkey, 'reward=' || round(o_orderkey % 4 / 3.0::DOUBLE, 3) || CASE WHEN o_orderkey % 5 > 0 THEN ',rca_accuracy=' || (o_orderkey % 2)::DOUBLE ELSE '' END || CASE WHEN o_orderkey % 3 > 0 THEN ',hallucinate_any=' || (o_orderkey % 3 = 1)::INT::DOUBLE ELSE '' END AS rewards FROM orders
""")
def reward_maps(t: Tables) -> DataFrame:
    """What a verifier writes: the reward and those of the other numbers that are known."""
    rewards = verdicts.reward_map(F.round((_o() % 4) / 3, 3), F.when(_o() % 5 > 0, _o() % 2 == 1), F.when(_o() % 3 > 0, _o() % 3 == 1))
    return t.orders.select("o_orderkey", F.array_join(F.transform(F.map_entries(rewards), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("rewards"))


@query("""
    SELECT c_custkey, 'agent=' || c_mktsegment || CASE WHEN c_acctbal > 0 THEN ',date=' || (c_nationkey % 9 + 1) ELSE '' END AS metadata, CASE WHEN c_acctbal > 0 THEN strftime(DATE '2026-06-01' + CAST(c_nationkey AS INT), '%b %-d, %Y') END AS date_display FROM customer
""")
def hub_metadata(t: Tables) -> DataFrame:
    """Metadata with only the keys that are allowed and known, and the date as it is shown."""
    known = F.col("c_acctbal") > 0
    day = F.when(known, F.date_add(F.lit("2026-06-01").cast("date"), F.col("c_nationkey")))
    metadata = F.create_map(F.lit("agent"), F.col("c_mktsegment"), F.lit("secret"), F.col("c_name"), F.lit("date"), F.when(known, (F.col("c_nationkey") % 9 + 1).cast("string")))
    kept = checks.stripped(metadata, ["agent", "date", "org"])
    return t.customer.select("c_custkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"), times.short_date(day).alias("date_display"))


@query("""
    WITH schema AS (SELECT DISTINCT p_name AS key FROM part WHERE p_size > 10), computed AS (SELECT DISTINCT p_name AS key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 40)
    SELECT 'computed' AS side, key FROM (SELECT key FROM computed EXCEPT SELECT key FROM schema) UNION ALL SELECT 'schema', key FROM (SELECT key FROM schema EXCEPT SELECT key FROM computed)
""")
def schema_keys(t: Tables) -> DataFrame:
    """Keys of a schema (names of larger parts) that are not computed, and computed ones (names of smaller parts that were ordered) that it lacks."""
    key = F.col("p_name").alias("name")
    schema = t.part.where("p_size > 10").select(key)
    computed = t.lineitem.join(t.part.where("p_size < 40"), F.col("l_partkey") == F.col("p_partkey")).select(key)
    return checks.key_differences(schema, computed, "name")


@query("""
    WITH j AS (SELECT o_custkey AS job, max(o_orderdate) AS last, any_value(CASE WHEN o_custkey % 3 > 0 THEN TIMESTAMP '2030-01-01' END) AS finished FROM orders GROUP BY 1)
    SELECT job, coalesce(finished, last) AS finished FROM j
""")
def job_dates(t: Tables) -> DataFrame:
    """When a job ended: as it says, else with its last trial."""
    said = F.when(_c() % 3 > 0, F.lit("2030-01-01").cast("timestamp_ntz"))
    return t.orders.groupBy(_c().alias("job")).agg(F.max("o_orderdate").alias("last"), F.max(said).alias("said")).select("job", F.coalesce("said", "last").alias("finished"))


@query("""
    SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS effort, CASE WHEN o_custkey % 4 < 3 THEN true ELSE false END AS matched FROM orders
""")
def effort_lookup(t: Tables) -> DataFrame:
    """The effort of each trial from its job's configuration, by agent and model; whether any agent there fits."""
    agents = F.array(*[F.struct(F.lit(f"a{k}").alias("agent"), F.lit(f"m{k}").alias("model"), F.lit(e).cast("string").alias("effort")) for k, e in enumerate(("low", "high", None))])
    config = t.spark.range(1).select(F.inline(agents)).withColumn("matched", F.lit(True))
    rows = t.orders.select("o_orderkey", _cat("a", _c() % 4).alias("agent"), _cat("m", _c() % 4).alias("model"))
    return rows.join(config, ["agent", "model"], "left").select("o_orderkey", "effort", F.coalesce("matched", F.lit(False)).alias("matched"))


@query("""
    SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS display, CASE WHEN n_regionkey <> 2 THEN 'Org ' || r_name END AS org, n_regionkey = 2 AS incomplete FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def display_lookup(t: Tables) -> DataFrame:
    """Display names from a mapping that may lack some, which are listed as incomplete; an absent mapping file is an empty one."""
    names = t.nation.where("n_regionkey <> 2").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("display"), F.concat(F.lit("Org "), "r_name").alias("org"))
    found = trees.mapping(t.spark, sinks.workspace(t.spark, "nowhere") + "/names.json", "key long, display string").select(F.col("key").alias("c_nationkey"), F.col("display").alias("other"))
    rows = t.customer.select("c_custkey", "c_nationkey").join(names, "c_nationkey", "left").join(found, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("display", "other").alias("display"), "org", (F.col("display").isNull() | F.col("org").isNull()).alias("incomplete"))


_BATCH = "CASE WHEN s_nationkey % 4 = 3 THEN 'unknown (unknown)' ELSE 'terminus-' || (s_nationkey % 4) || ' (' || ['claude-opus-4.7', 'gpt-5.5', 'glm-5'][CAST(s_nationkey % 4 + 1 AS INT)] || ')' || CASE WHEN s_nationkey % 4 = 0 THEN ' (high)' ELSE '' END END"


@query(f"SELECT 't' || s_suppkey AS trial_id, {_BATCH} AS grp, CASE s_nationkey % 4 WHEN 0 THEN 'Opus 4.7' WHEN 1 THEN 'GPT-5.5' WHEN 2 THEN 'GLM-5' ELSE 'unknown' END AS short, CASE s_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS place FROM supplier")
def trial_groups(t: Tables) -> DataFrame:
    """Each trial's group from its batch's configuration, the model's short name read back out of the label, and its place in the order of models."""
    n = F.col("s_nationkey") % 4
    batches = t.supplier.select(n.alias("n")).distinct().where("n < 3")
    model = F.element_at(F.array(*map(F.lit, ["gradient_ai/anthropic-claude-opus-4.7", "openai/gpt-5.5-2025-08-07", "glm-5-preview"])), (F.col("n") + 1).cast("int"))
    agent = F.struct(_cat("terminus-", F.col("n")).alias("name"), model.alias("model_name"), F.struct(F.when(F.col("n") == 0, F.lit("high")).alias("reasoning_effort")).alias("kwargs"))
    root = _files(t, "batches", batches.select(_cat("batch", F.col("n"), "/config.json").alias("path"), F.to_json(F.struct(F.array(agent, agent).alias("agents"))).alias("body")))
    rows = t.supplier.select(_cat("t", F.col("s_suppkey")).alias("trial_id"), _cat("batch", n).alias("batch")).join(trees.batch_groups(t.spark, root), "batch", "left")
    label = text.group_label(F.coalesce("agent", F.lit("unknown")), F.coalesce("model", F.lit("unknown")), F.col("effort"))
    found = rows.select("trial_id", label.alias("grp")).withColumn("short", text.model_of_label(F.col("grp")))
    return found.withColumn("place", text.model_rank(F.col("short"))["place"])


@query("""
    SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, (s_suppkey || repeat('9', CAST(s_suppkey % 28 AS INT)))::HUGEINT) AS BIGINT) AS place FROM supplier
""")
def natural_order(t: Tables) -> DataFrame:
    """Folders batch-2/t10 and the like in the order of their numbers, which have up to thirty digits and, some of them, leading zeros."""
    k = F.col("s_suppkey")
    zeros = F.repeat(F.lit("0"), (k % 3).cast("int"))
    # Without a number there is a letter, which sorts behind all numbers.
    told = lambda *parts: F.coalesce(F.concat(*parts), F.lit("x"))
    name = F.concat(F.lit("batch-"), told(F.col("s_nationkey").cast("string")), F.lit("/t"), told(zeros, k.cast("string"), F.repeat(F.lit("9"), (k % 28).cast("int"))))
    # Folders 2/t299 and 2/t0299 have equal numbers: these go by the supplier's own.
    return ordering.placed(t.supplier.select("s_suppkey", ordering.natural_key(name).alias("key")), ["key", "s_suppkey"]).select("s_suppkey", "place")


@query("""
    SELECT c_custkey, 'run-' || c_nationkey AS task_type, c_custkey::VARCHAR AS task_idx, 'lag5' AS lag, 'availx' AS avail, 'job' || c_custkey AS job, CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'p/m' END AS model,
      'Report ' || c_custkey || ' {x} ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END || ' {unknown}' AS rendered, CASE WHEN c_nationkey % 2 = 0 THEN 'gpt-5.2' ELSE 'claude-4.6-sonnet' END AS display FROM customer
""")
def names_and_texts(t: Tables) -> DataFrame:
    """Names taken apart and put together: runs, job links, models, templates."""
    n, c = F.col("c_nationkey"), F.col("c_custkey")
    run = text.run_name(_cat("run-", n, "-", c, "-lag5-availx__ab12"))
    model = F.when(n % 2 == 0, F.lit("openai/gpt-5.2-2025-08-07")).otherwise(F.lit("gradient_ai/anthropic-claude-4.6-sonnet-latest"))
    return t.customer.select(
        "c_custkey",
        run["task_type"].alias("task_type"),
        run["task_idx"].alias("task_idx"),
        run["lag"].alias("lag"),
        run["avail"].alias("avail"),
        text.last_segment(_cat("https://hub/jobs/job", c, "//")).alias("job"),
        text.joined_model(F.when(n % 2 > 0, F.lit("p")).otherwise(F.lit("unknown")), F.lit("m")).alias("model"),
        text.rendered("Report {id} {{x}} {segment} {unknown}", {"id": c, "segment": F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))}).alias("rendered"),
        text.display_name(model).alias("display"),
    )


@query("""
    WITH w AS (SELECT c_custkey AS k, sha1('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS fp FROM customer)
    SELECT k AS c_custkey, fp AS fingerprint FROM w WHERE k % 3 = 0 OR k % 6 = 1
""")
def cache_misses(t: Tables) -> DataFrame:
    """Work whose fingerprint the cache lacks or holds with an error."""
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    work = rows.select("c_custkey", sinks.fingerprint("segment", "name").alias("fingerprint"))
    cache = work.where("c_custkey % 3 <> 0").select("fingerprint", (F.col("c_custkey") % 6 == 1).alias("errored"))
    return sinks.todo(work, cache, ["fingerprint"], "errored")


@query("""
    SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT n_name, 0 FROM nation WHERE n_regionkey = 1
""")
def upserted_names(t: Tables) -> DataFrame:
    """A mapping with stub rows for names that it lacks."""
    old = t.customer.groupBy(F.col("c_mktsegment").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    new = t.nation.where("n_regionkey = 1").select(F.col("n_name").alias("key"), F.lit(0).cast("long").alias("n")).unionByName(old.select("key", F.lit(0).cast("long").alias("n")))
    return sinks.upserted(old, new, ["key"])


@query("SELECT o_custkey, round(avg(o_orderkey % 4) / 3, 6) AS reward, bool_and(o_orderkey % 3 <> 0) AS rca, count(*) AS n FROM orders GROUP BY 1")
def checked_scores(t: Tables) -> DataFrame:
    """Rubric scores checked to lie between 0 and 3 before they are averaged."""
    rows = t.orders.select("o_custkey", verdicts.checked_score(_o() % 4).alias("score"), (_o() % 3 != 0).alias("hit"))
    return rows.groupBy("o_custkey").agg(r6(F.avg("score") / 3).alias("reward"), verdicts.all_of(F.col("hit")).alias("rca"), F.count(F.lit(1)).alias("n"))


