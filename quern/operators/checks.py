"""Checks of submissions: which trials belong, whether configurations were left alone, what is published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import stats

# Settings that a run must leave unset, with the section they stand in.
FORBIDDEN = [
    "agent_timeout_multiplier",
    "verifier_timeout_multiplier",
    "agent_setup_timeout_multiplier",
    "environment_build_timeout_multiplier",
    "agent.override_timeout_sec",
    "agent.override_setup_timeout_sec",
    "agent.max_timeout_sec",
    "verifier.override_timeout_sec",
    "verifier.max_timeout_sec",
    "environment.override_cpus",
    "environment.override_gpus",
    "environment.override_memory_mb",
    "environment.override_storage_mb",
]
# Errors after which a trial's report is judged all the same, and those that another attempt may not repeat.
JUDGEABLE = ["AgentTimeoutError", "NonZeroAgentExitCodeError"]
FATAL = ["AuthenticationError", "PermissionDeniedError"]
RETRYABLE = ["APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError", "JSONDecodeError", "ValueError"]


def overrides(config: Column) -> Column:
    """key=value for every forbidden setting of a map that is not null, in the order of FORBIDDEN."""
    keys = F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda k: F.try_element_at(config, k).isNotNull())
    return F.transform(keys, lambda k: F.concat(k, F.lit("="), F.try_element_at(config, k)))


def config_failures(multiplier: Column, config: Column) -> Column:
    """What is wrong with a configuration: a timeout multiplier other than none or 1, then forbidden settings."""
    scaled = F.when(multiplier.isNotNull() & (multiplier != 1), F.array(F.concat(F.lit("timeout_multiplier="), multiplier.cast("string"))))
    return F.concat(F.coalesce(scaled, F.array().cast("array<string>")), overrides(config))


def dataset_failure(datasets: Column, name: Column, ref: Column) -> Column:
    """Empty if a run's datasets (name, ref) name the board's one, at the pinned version or at none; else why not."""
    own = F.filter(datasets, lambda d: d["name"] == name)
    refs = F.filter(F.transform(own, lambda d: d["ref"]), lambda r: r.isNotNull())
    return F.when(F.size(own) == 0, F.concat(F.lit("did not run "), name)).when((F.size(refs) > 0) & ~F.array_contains(refs, ref), F.lit("ref mismatch")).otherwise(F.lit(""))


def digest_failures(trials: DataFrame, canonical: DataFrame) -> DataFrame:
    """trials (task, ref, ...) with digest_failure: empty, not in dataset, or ref mismatch."""
    rows = trials.join(canonical.select("task", F.col("ref").alias("__ref")), "task", "left")
    why = F.when(F.col("__ref").isNull(), F.concat(F.col("task"), F.lit(" not in dataset"))).when(~F.col("ref").eqNullSafe(F.col("__ref")), F.concat(F.col("task"), F.lit(" ref mismatch"))).otherwise(F.lit(""))
    return rows.withColumn("digest_failure", why).drop("__ref")


def summary(rows: DataFrame, group: Sequence[str], failure: str) -> DataFrame:
    """group with bad and summary, 'N/total bad (most common reason)'; empty where nothing is. Ties go by name."""
    per = rows.groupBy(*group, failure).agg(F.count(F.lit(1)).alias("__n"))
    bad = F.col(failure) != ""
    out = per.groupBy(*group).agg(F.sum("__n").alias("__all"), F.coalesce(F.sum(F.when(bad, F.col("__n"))), F.lit(0)).alias("bad"), F.min_by(failure, F.when(bad, F.struct(-F.col("__n"), F.col(failure)))).alias("__top"))
    told = F.concat(F.col("bad").cast("string"), F.lit("/"), F.col("__all").cast("string"), F.lit(" bad ("), F.col("__top"), F.lit(")"))
    return out.select(*group, "bad", F.coalesce(told, F.lit("")).alias("summary"))


def routed(submissions: DataFrame, boards: DataFrame) -> DataFrame:
    """submissions with the dataset of their board: none named means public, an unknown one stops the job."""
    rows = submissions.withColumn("board", F.coalesce("board", F.lit("public"))).join(boards.select("board", "dataset"), "board", "left")
    stop = F.raise_error(F.concat(F.lit("unknown board: "), F.col("board")))
    return rows.withColumn("dataset", F.coalesce("dataset", stop.cast("string")))


def submission_trials(trials: DataFrame, submissions: DataFrame) -> DataFrame:
    """Trials of each submission: equal in source, agent, version and model (provider and name joined)."""
    rows = trials.withColumn("__model", text.joined_model(F.col("provider"), F.col("model")))
    on = [F.col("source") == F.col("dataset"), F.col("agent") == F.col("want_agent"), F.col("version") == F.col("want_version"), F.col("__model") == F.col("want_model")]
    wanted = submissions.select("submission", "dataset", F.col("agent").alias("want_agent"), F.col("version").alias("want_version"), F.col("model").alias("want_model"))
    return rows.join(wanted, on).select("submission", *trials.columns)


def finished_unjudged(source: Column, private: str, evals: Column, reward: Column, error: Column) -> Column:
    """Whether a trial of the private board ran to its end and waits for its verdict."""
    done = error.isNull() | error.isin(*JUDGEABLE)
    return F.coalesce((source == private) & evals.eqNullSafe(F.lit("{}")) & reward.isNull() & done, F.lit(False))


def retryable(error: Column) -> Column:
    """Whether another attempt might do better; what is fatal never is."""
    return ~error.isin(*FATAL) & error.isin(*RETRYABLE)


def labelled(trials: DataFrame, labels: DataFrame) -> DataFrame:
    """trials with difficulty and is_control of their task; a task without label stops the job."""
    rows = trials.join(labels.select("task", "difficulty", "is_control"), "task", "left")
    stop = F.raise_error(F.concat(F.lit("no label for task "), F.col("task"))).cast("boolean")
    return rows.withColumn("is_control", F.coalesce("is_control", stop))


#: (key, column, difficulty): what is published, over incident tasks, of one difficulty or of all.
PUBLISHED = [("rca_accuracy_incident_medium", "rca_accuracy", "medium"), ("rca_accuracy_incident_hard", "rca_accuracy", "hard"), ("hallucinate_any_incident", "hallucinate_any", None)]


def published(trials: DataFrame, group: Sequence[str], specs: Sequence[tuple[str, str, str | None]] = PUBLISHED) -> DataFrame:
    """group, key, mean, se and n of every published metric in percent, each over the trials of its subset that have a value. A subset that is empty stops the job.

    Every trial is turned into one row per metric that its task belongs to; the rest is one
    grouped aggregate per task and one per metric.
    """
    entry = lambda key, value, tier: F.when(~F.col("is_control") & (F.lit(True) if tier is None else F.col("difficulty") == tier), F.struct(F.lit(key).alias("key"), stats.checked_reward(F.col(value)).alias("value")))
    rows = trials.select(*group, "task", F.inline(F.array_compact(F.array(*[entry(*s) for s in specs]))))
    found = stats.graded_accuracy(rows, [*group, "key"], ["task"], "value")
    wanted = trials.select(*group).distinct().select(*group, F.explode(F.array(*[F.lit(k) for k, _, _ in specs])).alias("key"))
    stop = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("no trials for "), F.col("key"))).cast("double"))
    out = wanted.join(found, [*group, "key"], "left")
    return out.select(*group, "key", F.round(100 * stop(F.col("mean")), 2).alias("mean"), F.round(100 * F.col("se"), 2).alias("se"), F.col("n_trials").alias("n"))


def stripped(metadata: Column, allowed: Sequence[str]) -> Column:
    """A map with nothing but the allowed keys, and of these those that are not null."""
    return F.map_filter(metadata, lambda k, v: k.isin(*allowed) & v.isNotNull())


def private_finished(source: Column, board: str, n_evals: Column, error: Column) -> Column:
    """Whether a trial of the private board reached its verifier: no verdict (an empty map of them; null: none was made), and no error but those after which a report is judged."""
    return F.coalesce((source == board) & (n_evals == 0) & (error.isNull() | error.isin(*JUDGEABLE)), F.lit(False))


def coverage(trials: DataFrame, private: bool) -> DataFrame:
    """task and n, the trials that cover it: those with a verdict or an override and, on the private board, those that finished without either.

    trials: task, reward, overridden, finished. A trial that was overridden counts once. Tasks that nothing covers are absent.
    """
    judged = F.coalesce(F.col("overridden"), F.lit(False)) | F.col("reward").isNotNull()
    finished = F.coalesce(F.col("finished"), F.lit(False)) & ~F.coalesce(F.col("overridden"), F.lit(False)) if private else F.lit(False)
    n = judged.cast("long") + finished.cast("long")
    return trials.groupBy("task").agg(F.sum(n).alias("n")).where("n > 0")


def coverage_failure(covered: DataFrame, n_expected: int | Column, least: int) -> DataFrame:
    """One row, failure: empty if as many tasks are covered as are expected, each by at least `least` trials; else what is wrong, the number of tasks before the number of trials."""
    found = covered.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("n") < least).alias("short"))
    expected = F.lit(n_expected) if isinstance(n_expected, int) else n_expected
    missing = F.concat(F.col("tasks").cast("string"), F.lit(" tasks (expected "), expected.cast("string"), F.lit(")"))
    few = F.concat(F.col("short").cast("string"), F.lit(f" task(s) below {least} trials"))
    return found.select(F.when(F.col("tasks") != expected, missing).when(F.col("short") > 0, few).otherwise(F.lit("")).alias("failure"))


def key_differences(schema: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """side, key: keys that are computed and that the schema lacks, and keys of the schema that are not computed."""
    one = lambda a, b, side: a.select(key).exceptAll(b.select(key)).distinct().select(F.lit(side).alias("side"), F.col(key).alias("key"))
    have, want = computed.select(key).distinct(), schema.select(key).distinct()
    return one(have, want, "computed").unionByName(one(want, have, "schema"))
