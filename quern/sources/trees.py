"""Readers of directory trees of JSON, text and recordings as DataFrames.

Trees of many files are listed and read by tasks (quern.sources.files), as Spark's readers would list them on
the driver. Fields that a file's name carries come from its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quern.operators import trajectory
from quern.sources import schemas
from quern.sources.files import bodies, listed, put_files

#: A tree of files: its root or, to list it once for several readers, its listing.
Tree = str | DataFrame


def _listing(spark: SparkSession, tree: Tree, deep: bool = True) -> DataFrame:
    return listed(spark, tree, deep) if isinstance(tree, str) else tree


def _named(spark: SparkSession, tree: Tree, pattern: str) -> DataFrame:
    """path and value, the whole text, of the files of a tree whose name has a pattern."""
    files = _listing(spark, tree)
    return bodies(files.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(f"^(?:{pattern})$")))


def _read_json(rows: DataFrame, schema: str, bad: str = "_corrupt_record") -> DataFrame:
    """path and the columns of a schema for every JSON text (column value), as Spark's reader has them: a row per item of an array, none for a blank file, nulls for one that can't be read."""
    body = F.ltrim(F.regexp_replace("value", "^\ufeff", ""), F.lit(" \t\r\n"))
    kind, how = StructType.fromDDL(schema), {"columnNameOfCorruptRecord": bad}
    one, many = F.from_json("body", kind, how), F.from_json("body", ArrayType(kind), how)
    each = F.when(F.col("body").startswith("["), F.coalesce(many, F.array(one))).otherwise(F.array(one))
    found = rows.select("path", body.alias("body")).where("body <> ''").select("path", F.explode(each).alias("r"))
    return found.select("path", *[F.col("r")[c].alias(c) for c in kind.fieldNames()])


def file_stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def json_files(spark: SparkSession, path: Tree, schema: str, key: str = "stem") -> DataFrame:
    """One row per JSON file of a folder, keyed by its name; a file that can't be read has nulls."""
    rows = _read_json(bodies(_listing(spark, path, deep=False)), schema)
    return rows.select(file_stem(F.col("path")).alias(key), *rows.columns[1:])


def incidents(spark: SparkSession, path: str) -> DataFrame:
    return json_files(spark, path, schemas.INCIDENT, "incident_id")


def toggle_events(spark: SparkSession, path: str) -> DataFrame:
    """Schedule events; ids must be unique."""
    rows = _read_json(bodies(_listing(spark, path, deep=False)), schemas.TOGGLE).drop("path")
    return unique(rows, ["id"])


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, failing at run time where a key is repeated."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stop = F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(",", *keys)))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, stop.cast("boolean")).otherwise(F.lit(True))).drop("__n")


def write_specs(specs: DataFrame, root: str, key: str) -> None:
    """One JSON file per row, named after its key, written by tasks and placed together; a key that two rows have stops the job before any file is placed."""
    body = F.to_json(F.struct(*[c for c in specs.columns if c != key]))
    put_files(unique(specs, [key]).select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("path"), body.alias("body")), root)


#: What became of a trial's folder when it was read.
SCORED, NO_DETAILS, BAD_JSON, OTHER_EFFORT, NO_RUBRICS = "scored", "no details", "bad json", "other effort", "no rubrics"
_TRIAL = r"([^/]+)/verifier/[^/]+$"


def trial_outcomes(spark: SparkSession, root: Tree, effort: str | None = None, details: str = "reward-details.json") -> DataFrame:
    """One row per trial of a tree: folders with a verifier/ in the root itself or in a batch below it.

    outcome tells why a trial is not scored: no details, unreadable ones, another reasoning
    effort than asked for, no rubrics. Trial ids are the folders' names and must be unique.
    """
    files = _listing(spark, root)
    seen = files.where(F.col("inside").rlike(r"^(?:[^/]+/){1,2}verifier/[^/]+$")).select(F.regexp_extract("inside", r"^(.*)/verifier/[^/]+$", 1).alias("folder")).distinct()
    folders = unique(seen.select(F.substring_index("folder", "/", -1).alias("trial_id"), "folder"), ["trial_id"])
    schema = f"{schemas.VERDICT}, model string, reasoning_effort string, _bad string"
    rows = _read_json(_named(spark, files, re.escape(details)), schema, "_bad")
    found = rows.select(F.regexp_extract("path", _TRIAL, 1).alias("trial_id"), F.lit(True).alias("__has"), F.col("_bad").isNotNull().alias("__bad"), "mode", "model", "reasoning_effort", F.col("nested.rubrics").alias("rubrics"))
    other = F.lit(False) if effort is None else ~F.col("reasoning_effort").eqNullSafe(F.lit(effort))
    outcome = F.when(F.col("__has").isNull(), NO_DETAILS).when(F.col("__bad"), BAD_JSON).when(other, OTHER_EFFORT).when(F.coalesce(F.size("rubrics"), F.lit(0)) <= 0, NO_RUBRICS).otherwise(SCORED)
    return folders.select("trial_id").join(found, "trial_id", "left").select("trial_id", outcome.alias("outcome"), "mode", "model", "reasoning_effort", "rubrics")


def trials(spark: SparkSession, root: Tree, effort: str | None = None) -> DataFrame:
    """The scored trials of a tree."""
    return trial_outcomes(spark, root, effort).where(F.col("outcome") == SCORED).drop("outcome")


def reports(spark: SparkSession, root: Tree, name: str = "report.md") -> DataFrame:
    """trial_id and the whole text of each trial's report."""
    rows = _named(spark, root, re.escape(name))
    return rows.select(F.regexp_extract("path", r"([^/]+)/(?:verifier/|agent/)?[^/]+$", 1).alias("trial_id"), F.col("value").alias("report"))


def with_reports(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found with report, empty where a trial has none."""
    return found.join(texts, "trial_id", "left").withColumn("report", F.coalesce("report", F.lit("")))


def agent_configs(spark: SparkSession, root: Tree) -> DataFrame:
    """trial_id, agent, model, effort, task and ref of each trial's config.json; a file that can't be read has nulls, as a trial without one will."""
    rows = _read_json(_named(spark, root, r"config\.json"), schemas.TRIAL_CONFIG)
    trial = F.regexp_extract("path", r"([^/]+)/config\.json$", 1)
    return rows.select(trial.alias("trial_id"), F.col("agent.name").alias("agent"), F.col("agent.model_name").alias("model"), F.col("agent.kwargs.reasoning_effort").alias("effort"), F.col("task.name").alias("task"), F.col("task.ref").alias("ref"))


def batch_groups(spark: SparkSession, root: Tree) -> DataFrame:
    """batch and the agent, model and effort of the first agent of its config.json, unknown where there is none."""
    rows = _read_json(_named(spark, root, r"config\.json"), schemas.BATCH_CONFIG)
    first = F.get("agents", F.lit(0))
    unknown = F.lit("unknown")
    batch = F.regexp_extract("path", r"([^/]+)/config\.json$", 1)
    return rows.select(batch.alias("batch"), F.coalesce(first["name"], unknown).alias("agent"), F.coalesce(first["model_name"], unknown).alias("model"), first["kwargs"]["reasoning_effort"].alias("effort"))


def call_usage(spark: SparkSession, root: Tree) -> DataFrame:
    """trial_id, model and usage of every finished call: debug.json files of episodes, whose response is JSON in a JSON string."""
    rows = _read_json(_named(spark, root, r"debug\.json"), schemas.CALL)
    trial = F.regexp_extract("path", r"([^/]+)/(?:agent/)?episode-[^/]+/debug\.json$", 1)
    answer = F.from_json("original_response", schemas.RESPONSE)
    calls = rows.where((F.col("log_event_type") == "post_api_call") & (trial != "")).select(trial.alias("trial_id"), F.col("model").alias("asked"), answer.alias("r"), F.try_parse_json("original_response").isNotNull().alias("good"))
    return calls.where(F.col("good") & F.col("r").isNotNull()).select("trial_id", F.substring_index(F.coalesce(F.nullif(F.col("r.model"), F.lit("")), "asked", F.lit("")), "/", -1).alias("model"), F.col("r.usage").alias("usage"))


def judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """One row per judged trial of a scores file {trial_id: record}; a record under another trial's id stops the job."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{schemas.SCORE}>")).alias("key", "r"))
    stop = F.raise_error(F.concat(F.lit("not a scores file: record of "), F.coalesce(F.col("r.trial_id"), F.lit("nobody")), F.lit(" under "), F.col("key")))
    same = F.col("r.trial_id").eqNullSafe(F.col("key"))
    return rows.where(F.when(same, F.lit(True)).otherwise(stop.cast("boolean"))).select("r.*")


#: The judge's record of a trial that it could not score.
JUDGE_ERRORS = ("llm_judge_error", "hub_fetch_error")


def judged(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows (trial_id and more) with judge_mode, reward, rca_accuracy and hallucinate_any of their scores, and problem: missing, errored or null. An errored record counts as none."""
    errored = F.col("mode").isin(*JUDGE_ERRORS)
    good = lambda c: F.when(~errored, F.col(c))
    own = scores.select("trial_id", good("mode").alias("judge_mode"), *[good(c).alias(c) for c in ("reward", "rca_accuracy", "hallucinate_any")], errored.alias("__bad"))
    joined = rows.join(own, "trial_id", "left")
    return joined.withColumn("problem", F.when(F.col("__bad").isNull(), F.lit("missing")).when(F.col("__bad"), F.lit("errored"))).drop("__bad")


#: Errors after which a trial still counts: it had its full time.
KEPT_ERRORS = ("AgentTimeoutError",)


def predictions(spark: SparkSession, root: Tree, kept: Sequence[str] = KEPT_ERRORS) -> DataFrame:
    """trial_id, exception, kept and report of every trial with a result.json."""
    root = _listing(spark, root)
    rows = _read_json(_named(spark, root, r"result\.json"), "exception_info struct<exception_type:string>")
    trial = F.regexp_extract("path", r"([^/]+)/result\.json$", 1)
    error = F.col("exception_info.exception_type")
    found = rows.select(trial.alias("trial_id"), error.alias("exception"), (error.isNull() | error.isin(*kept)).alias("kept"))
    return with_reports(found, reports(spark, root))


def expected_events(spark: SparkSession, root: Tree) -> DataFrame:
    """task and the events its expected.json lists, in order."""
    rows = _read_json(_named(spark, root, r"expected\.json"), "events array<struct<event_id:string, root_cause:string, event_time:string>>")
    return rows.select(F.regexp_extract("path", r"([^/]+)/expected\.json$", 1).alias("task"), F.coalesce("events", F.array().cast("array<struct<event_id:string,root_cause:string,event_time:string>>")).alias("events"))


def open_name(task: Column) -> Column:
    """The name of a hidden task's open twin."""
    return F.regexp_replace(task, "-hidden$", "")


def ground_truth(tasks: DataFrame, expected: DataFrame, rubrics: DataFrame) -> DataFrame:
    """tasks with their expected events and the rubrics of these in the same order. A rubric's file is named after event and flag, else after the event alone; events without one are left out."""
    rows = tasks.withColumn("__open", open_name(F.col("task"))).join(expected.select(F.col("task").alias("__open"), "events"), "__open", "left").drop("__open")
    each = rows.select("task", F.posexplode("events").alias("place", "e"))
    names = F.array(F.concat("e.event_id", F.lit("-"), "e.root_cause"), F.col("e.event_id"))
    paths = each.select("task", "place", F.posexplode(names).alias("rank", "incident_id"))
    hit = paths.join(rubrics.select("incident_id", "feature_flag", "mechanism"), "incident_id").groupBy("task", "place").agg(F.min_by(F.struct("feature_flag", "mechanism"), "rank").alias("r"))
    told = hit.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda x: x["r"]).alias("rubrics"))
    none = F.array().cast("array<struct<feature_flag:string,mechanism:string>>")
    return rows.join(told, "task", "left").withColumn("rubrics", F.coalesce("rubrics", none))


def day_range(spark: SparkSession, path: str, first: str, last: str, ts: str = "ts", day: str = "day") -> DataFrame:
    """Rows of a table partitioned by day whose time lies in a closed range, in order of time; the days outside are not read."""
    lo, hi = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")
    return spark.read.parquet(path).where(F.col(day).between(F.to_date(lo), F.to_date(hi)) & F.col(ts).between(lo, hi)).orderBy(ts)


def tool_calls(spark: SparkSession, root: Tree) -> DataFrame:
    """One row per tool call of trajectories .../<trial>/trajectory.json, with its result: by call id, else the step's last shared result."""
    rows = _read_json(_named(spark, root, r"trajectory\.json"), schemas.TRAJECTORY)
    trial = F.regexp_extract("path", r"([^/]+)/(?:agent/)?trajectory\.json$", 1)
    steps = rows.select(trial.alias("trial_id"), F.explode("steps").alias("s"))
    calls = steps.select("trial_id", "s.step_id", "s.source", F.posexplode("s.tool_calls").alias("place", "call"), F.col("s.observation.results").alias("results"))
    command = F.coalesce(F.nullif(F.rtrim(F.col("call.arguments")["keystrokes"], F.lit("\n")), F.lit("")), F.col("call.arguments")["cmd"])
    return calls.select("trial_id", "step_id", "source", "place", F.col("call.tool_call_id").alias("tool_call_id"), F.col("call.function_name").alias("function"), command.alias("command"), _result(F.col("results"), F.col("call.tool_call_id")).alias("result"))


def _result(results: Column, call: Column) -> Column:
    """What a step's results say of a call: the last with its id, else the last that names none."""
    last = lambda keep: F.try_element_at(F.filter(results, keep), F.lit(-1))["content"]
    return F.coalesce(last(lambda r: r["source_call_id"] == call), last(lambda r: r["source_call_id"].isNull()))


def agent_calls(spark: SparkSession, root: Tree) -> DataFrame:
    """The agent's own tool calls in order: trial_id, call (from 0), tool_call_id, what was typed (keystrokes, else the command) and the result that the trajectory has."""
    rows = _read_json(_named(spark, root, r"trajectory\.json"), schemas.TRAJECTORY)
    trial = F.regexp_extract("path", r"([^/]+)/(?:agent/)?trajectory\.json$", 1)

    def typed(arguments: Column) -> Column:
        return F.coalesce(F.nullif(arguments["keystrokes"], F.lit("")), arguments["cmd"], F.lit(""))

    def of_step(s: Column) -> Column:
        named = F.filter(s["tool_calls"], lambda c: F.coalesce(c["tool_call_id"], F.lit("")) != "")
        found = F.transform(named, lambda c: F.struct(c["tool_call_id"].alias("tool_call_id"), typed(c["arguments"]).alias("typed"), _result(s["observation"]["results"], c["tool_call_id"]).alias("result")))
        return F.coalesce(found, F.array().cast("array<struct<tool_call_id:string,typed:string,result:string>>"))

    own = F.flatten(F.transform(F.filter("steps", lambda s: s["source"] == "agent"), of_step))
    return rows.select(trial.alias("trial_id"), F.posexplode(own).alias("call", "c")).select("trial_id", "call", "c.*")


def casts(spark: SparkSession, root: Tree) -> DataFrame:
    """Events of terminal recordings (asciinema 2) with their line: the header and malformed lines are left out."""
    rows = _named(spark, root, r".*\.cast")
    lines = rows.select(F.regexp_extract("path", r"([^/]+)/(?:agent/)?[^/]+$", 1).alias("trial_id"), F.posexplode(F.split("value", "\n")).alias("line", "text")).where("line > 0")
    parts = lines.select("trial_id", "line", F.from_json("text", "array<string>").alias("e")).where(F.size("e") >= 3)
    return parts.select("trial_id", "line", F.element_at("e", 1).cast("double").alias("ts"), F.element_at("e", 2).alias("kind"), F.element_at("e", 3).alias("data")).where("ts is not null")


def output_slices(events: DataFrame) -> DataFrame:
    """For each input event of a recording, numbered from 0: the output after its time, up to and including the time of the next input, in the recording's order.

    Inputs of one time share what the last of them is given: nothing lies between equal times.
    """
    # An output belongs to the last input strictly before it: a running count over both kinds, inputs after outputs of the same time.
    order = Window.partitionBy("trial_id").orderBy("ts", F.when(F.col("kind") == "o", 0).otherwise(1), "line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.sum(F.when(F.col("kind") == "i", 1).otherwise(0)).over(order) - 1
    mine = lambda c: F.max(F.when(F.col("kind") == "i", F.col(c)))
    chunks = F.array_sort(F.collect_list(F.when(F.col("kind") == "o", F.struct("line", "data"))))
    owned = events.where("kind in ('i', 'o')").withColumn("n", owner).where("n >= 0").groupBy("trial_id", "n")
    return owned.agg(mine("ts").alias("ts"), mine("data").alias("input"), F.array_join(F.transform(chunks, lambda x: x["data"]), "").alias("output"))


def recovered(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Calls of the agent with the output recovered from the trial's recording, escape sequences dropped, null where none is: calls are placed in order at the inputs that hold them. Both sides are read once."""
    placed = trajectory.aligned(calls, output_slices(events), "trial_id", "call", "typed", "n", "input", [c for c in calls.columns if c not in ("trial_id", "call", "typed")], ["output"])
    return placed.drop("place").withColumn("output", F.regexp_replace("output", "\\x1b\\[[0-9;?]*[a-zA-Z]", ""))


def traces(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Traces as they are, one row each; lines: one to a line, else one to a file."""
    return spark.read.schema(schemas.SPANS).option("multiLine", not lines).json(path)


#: Operations that fail as a matter of course.
NOISE = ("flagd.evaluation.v1.Service/EventStream",)


def _failed(span: Column) -> Column:
    """Whether any tag `error` of a span is the JSON value true; the text "true" is not."""
    true = lambda t: (t["key"] == "error") & (F.schema_of_variant(t["value"]) == "BOOLEAN") & F.coalesce(F.try_variant_get(t["value"], "$", "boolean"), F.lit(False))
    return F.coalesce(F.exists(span["tags"], lambda t: F.coalesce(true(t), F.lit(False))), F.lit(False))


def _quiet(span: Column, noise: Sequence[str]) -> Column:
    return ~F.coalesce(span["operationName"].isin(*noise), F.lit(False))


def signal_traces(found: DataFrame, noise: Sequence[str] = NOISE) -> DataFrame:
    """Traces once each, whichever services they were found under, if any span outside the noise failed."""
    one = found.dropDuplicates(["traceID"])
    return one.where(F.coalesce(F.exists("spans", lambda s: _quiet(s, noise) & _failed(s)), F.lit(False)))


def spans(found: DataFrame) -> DataFrame:
    """One row per span of traces, with its service (unknown if its process isn't listed), whether it failed, and its logged fields: maps in order with values as they are (1 is not "1"), messages and empty ones left out, the last of a repeated key."""
    one = found.select("traceID", "processes", F.posexplode("spans").alias("place", "s"))
    service = F.coalesce(F.try_element_at("processes", F.col("s.processID"))["serviceName"], F.lit("unknown"))
    def field_map(log: Column) -> Column:
        keys = F.transform(log["fields"], lambda f: f["key"])
        last = F.filter(log["fields"], lambda f, k: ~F.array_contains(F.slice(keys, k + 2, F.greatest(F.size(keys) - k - 1, F.lit(0))), f["key"]))
        return F.map_from_entries(F.transform(last, lambda f: F.struct(f["key"], f["value"])))

    kept = F.filter(F.transform("s.logs", field_map), lambda m: (F.size(m) > 0) & ~F.coalesce(F.to_json(F.try_element_at(m, F.lit("event"))) == '"message"', F.lit(False)))
    return one.select("traceID", "place", F.col("s.spanID").alias("spanID"), service.alias("service"), F.col("s.operationName").alias("operation"), F.timestamp_micros("s.startTime").alias("ts"), _failed(F.col("s")).alias("failed"), kept.alias("events"))


def error_operations(found: DataFrame, noise: Sequence[str] = NOISE) -> DataFrame:
    """service, operation and the distinct events of its failed spans, in the order in which they are first met (by trace, then place); maps are compared as JSON."""
    rows = spans(found).where(F.col("failed") & ~F.coalesce(F.col("operation").isin(*noise), F.lit(False)))
    each = rows.select("service", "operation", "traceID", "place", F.posexplode_outer("events").alias("nth", "event"))
    first = each.withColumn("event", F.to_json("event")).groupBy("service", "operation", "event").agg(F.min(F.struct("traceID", "place", "nth")).alias("at"))
    told = F.array_sort(F.collect_list(F.when(F.col("event").isNotNull(), F.struct("at", "event"))))
    return first.groupBy("service", "operation").agg(F.transform(told, lambda x: x["event"]).alias("events"))


def toml_metadata(spark: SparkSession, root: Tree, name: str = "task.toml") -> DataFrame:
    """task and its [metadata] table as text (JSON where a value is no string); unreadable files have an empty map."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import tomllib

        for rows in batches:
            found = []
            for body in rows["value"]:
                try:
                    table = tomllib.loads(body).get("metadata", {})
                except tomllib.TOMLDecodeError:
                    table = {}
                found.append({k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in table.items()})
            yield pd.DataFrame({"task": rows["task"], "metadata": found})

    rows = _named(spark, root, re.escape(name))
    rows = rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task"), "value")
    return rows.mapInPandas(parse, "task string, metadata map<string,string>")


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the pipe tables of Markdown files: file, heading (the last one above), number in the file and cells."""
    rows = bodies(_listing(spark, path, deep=False)).select(file_stem(F.col("path")).alias("stem"), "value")
    parts = rows.select("stem", F.posexplode(F.split("value", r"\n(?=#+ )")).alias("part", "body"))
    lines = parts.select("stem", "part", F.trim(F.regexp_extract("body", r"^#+ ([^\n]*)", 1)).alias("heading"), F.posexplode(F.split("body", "\n")).alias("line", "text"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.where(F.trim("text").startswith("|") & ~F.col("text").rlike(r"^[\s|:\-]+$")).select("stem", "heading", "part", "line", cells.alias("cells"))


def named_metric(evals: Column, name: str, reward: Column | None = None) -> Column:
    """A metric by its name, never by its place, from either shape of an evaluation's JSON: {name: {metrics: [{name: x}]}} or, where there is a list of rows, these alone: {rows: [{metrics: [{name: x}]}]}.

    Null for a trial without evaluations. Evaluations without that name, a value that is no
    number, and a reward beside no evaluations stop the job: they tell of another contract.
    """
    body = F.try_parse_json(F.coalesce(evals, F.lit("{}")))
    blocks = F.try_variant_get(body, "$", "map<string,variant>")
    empty = F.coalesce(F.size(blocks), F.lit(0)) <= 0
    nested = F.flatten(F.transform(F.map_values(blocks), lambda b: F.coalesce(F.try_variant_get(b, "$.metrics", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))))
    rows = F.try_variant_get(body, "$.rows", "array<variant>")
    listed = F.flatten(F.transform(rows, lambda r: F.coalesce(F.try_variant_get(r, "$.metrics", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))))
    none = F.array().cast("array<map<string,variant>>")
    hits = F.filter(F.coalesce(F.when(rows.isNotNull(), listed).otherwise(nested), none), lambda m: F.map_contains_key(m, name))
    value = F.try_element_at(F.get(hits, F.lit(0)), F.lit(name))
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    stop = lambda why: F.raise_error(F.concat(F.lit(f"metric {name}: {why} in "), F.coalesce(evals, F.lit("nothing")))).cast("double")
    alone = F.lit(False) if reward is None else reward.isNotNull()
    return (
        F.when(empty & alone, stop("a reward without evaluations"))
        .when(empty, F.lit(None).cast("double"))
        .when(F.size(hits) <= 0, stop("absent"))
        .when(F.coalesce(number, F.lit(False)), F.try_variant_get(value, "$", "double"))
        .otherwise(stop("not a number"))
    )


def file_fields(name: Column, form: str, fields: Sequence[str]) -> Column:
    """Columns that a file's name carries, by the groups of a pattern; null where the name has another form."""
    return F.when(name.rlike(form), F.struct(*[F.regexp_extract(name, form, k + 1).alias(f) for k, f in enumerate(fields)]))


def yaml_config(path: str, allowed: Sequence[str], body: str | None = None) -> dict:
    """A YAML file's settings, read on the driver (parameters, not data); a key that isn't known stops the run."""
    import yaml

    if body is None:
        with open(path) as f:
            body = f.read()
    found = yaml.safe_load(body) or {}
    if extra := sorted(set(found) - set(allowed)):
        raise ValueError(f"unknown keys in {path}: {', '.join(extra)}")
    return found


def mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines mapping; no file is the same as an empty one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
