from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import sinks, trees
from quern.sources.files import put_files
from quern.sources.paged import paged


def put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body))


def test_incident_files_keep_nested_fields_and_nulls(spark, tmp_path):
    put(tmp_path / "a-1.json", {"incident_time": "2026-01-02T03:04:05Z", "feature_flag": "f", "symptoms": {"metrics": [{"metric_family": "m", "defining_labels": {"k": "v"}, "variants": [{"type": "rate", "onset_offset_seconds": None}]}], "logs": [], "frontend": [], "traces": []}})
    put(tmp_path / "b-2.json", "{not json")
    rows = {r.incident_id: r for r in trees.incidents(spark, str(tmp_path)).collect()}
    assert rows["a-1"].symptoms.metrics[0].defining_labels == {"k": "v"}
    assert rows["a-1"].symptoms.metrics[0].variants[0].onset_offset_seconds is None
    assert rows["b-2"].feature_flag is None


def test_repeated_ids_stop_the_job(spark, tmp_path):
    put(tmp_path / "a.json", {"id": "x", "flag": "f", "value": "on"})
    put(tmp_path / "b.json", {"id": "y", "flag": "f", "value": "off"})
    assert trees.toggle_events(spark, str(tmp_path)).count() == 2
    put(tmp_path / "c.json", {"id": "x", "flag": "g", "value": "on"})
    with pytest.raises(Exception, match="repeated key: x"):
        trees.toggle_events(spark, str(tmp_path)).collect()


def test_trials_at_either_depth_with_reports(spark, tmp_path):
    rubric = {"feature_flag": "f", "feature_flag_match": True, "mechanism_match": None, "score": 2}
    good = {"mode": "llm", "reasoning_effort": "high", "nested": {"rubrics": [rubric]}}
    put(tmp_path / "t1/verifier/reward-details.json", good)
    put(tmp_path / "job/t2/verifier/reward-details.json", {"mode": "llm", "reasoning_effort": "high", "nested": {"rubrics": []}})
    put(tmp_path / "job/t3/verifier/reward-details.json", "broken")
    put(tmp_path / "job/t4/verifier/log.txt", "died")
    put(tmp_path / "job/t5/verifier/reward-details.json", good | {"reasoning_effort": "low"})
    put(tmp_path / "job/deep/er/t6/verifier/reward-details.json", good)
    put(tmp_path / "job/t7/result.json", {})
    put(tmp_path / "t1/verifier/report.md", "# It was f")
    found = trees.trial_outcomes(spark, str(tmp_path), "high")
    assert {r.trial_id: r.outcome for r in found.collect()} == {"t1": trees.SCORED, "t2": trees.NO_RUBRICS, "t3": trees.BAD_JSON, "t4": trees.NO_DETAILS, "t5": trees.OTHER_EFFORT}
    rows = trees.with_reports(trees.trials(spark, str(tmp_path)), trees.reports(spark, str(tmp_path))).collect()
    assert sorted((r.trial_id, r.rubrics[0].score, r.rubrics[0].mechanism_match, r.report) for r in rows) == [("t1", 2, None, "# It was f"), ("t5", 2, None, "")]
    put(tmp_path / "other/t1/verifier/log.txt", "again")
    with pytest.raises(Exception, match="repeated key: t1"):
        trees.trial_outcomes(spark, str(tmp_path)).collect()


def test_tool_calls_take_their_own_result_or_the_last_shared_one(spark, tmp_path):
    call = lambda i, c: {"tool_call_id": i, "function_name": "sh", "arguments": {"cmd": c}}
    steps = [{"step_id": 1, "source": "agent", "tool_calls": [call("a", "ls"), call("b", "ps")], "observation": {"results": [{"source_call_id": "a", "content": "A"}, {"source_call_id": "a", "content": "A2"}, {"content": "S"}]}}, {"step_id": 2, "source": "user"}]
    put(tmp_path / "t1/trajectory.json", {"steps": steps})
    rows = trees.tool_calls(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.trial_id, r.step_id, r.command, r.result) for r in rows] == [("t1", 1, "ls", "A2"), ("t1", 1, "ps", "S")]


def test_recordings_are_cut_at_inputs(spark, tmp_path):
    lines = ['{"version": 2}', '[1.0, "o", "early"]', '[2.0, "i", "ls\\n"]', '[2.5, "o", "b"]', '[2.5, "o", "a"]', '[3.0, "o", "y"]', '[3.0, "i", "ps"]', "oops", '[4.0, "o", "\\u001b[1mz"]']
    put(tmp_path / "t1/run.cast", "\n".join(lines))
    events = trees.casts(spark, str(tmp_path))
    rows = trees.output_slices(events).orderBy("n").collect()
    assert [(r.n, r.input, r.output) for r in rows] == [(0, "ls\n", "bay"), (1, "ps", "\x1b[1mz")]
    # The second call of the same text can't take the first one's input again.
    calls = spark.createDataFrame([("t1", 0, "a", "ls\n"), ("t1", 1, "b", "ls\n"), ("t1", 2, "c", " \n"), ("t1", 3, "d", "ps")], "trial_id string, call int, tool_call_id string, typed string")
    found = {r.tool_call_id: r.output for r in trees.recovered(calls, events).collect()}
    assert found == {"a": "bay", "b": None, "c": None, "d": "z"}


def test_agent_calls_are_the_agents_own(spark, tmp_path):
    call = lambda i, **a: {"tool_call_id": i, "function_name": "sh", "arguments": a}
    steps = [{"step_id": 1, "source": "user", "tool_calls": [call("x", cmd="no")]}, {"step_id": 2, "source": "agent", "tool_calls": [call("a", keystrokes="ls\n", cmd="z"), call("b", cmd="ps"), call("", cmd="lost")]}, {"step_id": 3, "source": "agent"}, {"step_id": 4, "source": "agent", "tool_calls": [call("c", keystrokes="")]}]
    put(tmp_path / "t1/agent/trajectory.json", {"steps": steps})
    rows = trees.agent_calls(spark, str(tmp_path)).orderBy("call").collect()
    assert [(r.trial_id, r.call, r.tool_call_id, r.typed) for r in rows] == [("t1", 0, "a", "ls\n"), ("t1", 1, "b", "ps"), ("t1", 2, "c", "")]


def test_spans_fail_by_the_value_true_alone(spark, tmp_path):
    tag = lambda v: [{"key": "error", "value": v}]
    event = lambda *pairs: {"fields": [{"key": k, "value": v} for k, v in pairs]}
    span = lambda i, v, op="get", logs=(): {"spanID": i, "processID": "p", "operationName": op, "startTime": 1, "tags": tag(v), "logs": list(logs)}
    told = [event(("event", "message")), event(), event(("event", "boom"), ("n", 1), ("n", 2)), event(("event", "boom"), ("n", 2))]
    put(tmp_path / "1.json", {"traceID": "t", "processes": {"p": {"serviceName": "cart"}}, "spans": [span("1", True, logs=told), span("2", "true"), span("3", 1), span("4", None)]})
    put(tmp_path / "2.json", {"traceID": "u", "processes": {}, "spans": [span("5", True, trees.NOISE[0]), span("6", "true")]})
    put(tmp_path / "3.json", {"traceID": "t", "processes": {}, "spans": []})
    found = trees.traces(spark, str(tmp_path) + "/[12].json")
    rows = trees.spans(found).orderBy("spanID").collect()
    assert [(r.spanID, r.service, r.failed) for r in rows] == [("1", "cart", True), ("2", "cart", False), ("3", "cart", False), ("4", "cart", False), ("5", "unknown", True), ("6", "unknown", False)]
    assert [r[0] for r in trees.spans(found).where("spanID = '1'").select(F.explode(F.transform("events", lambda m: F.to_json(m)))).collect()] == ['{"event":"boom","n":2}'] * 2
    assert [r.traceID for r in trees.signal_traces(found.union(found)).collect()] == ["t"]
    assert [(r.service, r.operation, r.events) for r in trees.error_operations(found).collect()] == [("cart", "get", ['{"event":"boom","n":2}'])]


def test_toml_and_markdown(spark, tmp_path):
    put(tmp_path / "to/a/task.toml", '[metadata]\ndifficulty = "hard"\nn = 3\nevents = [{x = 1}]\n')
    put(tmp_path / "to/b/task.toml", "= nonsense")
    assert {r.task: r.metadata for r in trees.toml_metadata(spark, str(tmp_path / "to")).collect()} == {"a": {"difficulty": "hard", "n": "3", "events": '[{"x": 1}]'}, "b": {}}
    put(tmp_path / "md/f.md", "# One\n| a | b |\n|---|---|\n| 1 | 2 |\n## Two\ntext\n| c |\n")
    cells = [(r.heading, r.cells) for r in trees.markdown_tables(spark, str(tmp_path / "md")).orderBy("part", "line").collect()]
    assert cells == [("One", ["a", "b"]), ("One", ["1", "2"]), ("Two", ["c"])]


def metric(spark, evals, reward=None):
    row = spark.createDataFrame([(evals, reward)], "e string, r double")
    return row.select(trees.named_metric(F.col("e"), "score", F.col("r")).alias("x")).first().x


def test_named_metrics_are_read_by_name_or_stop_the_job(spark):
    assert metric(spark, '{"aaa": {"metrics": [{"aaa": 9}]}, "score": {"metrics": [{"score": 0.25}]}}') == 0.25
    assert metric(spark, '{"group_by": ["score"], "rows": [{"metrics": [{"aaa": 9}]}, {"metrics": [{"zzz": 1}, {"score": 1}]}]}') == 1.0
    assert metric(spark, "{}") is None and metric(spark, None) is None
    for bad in ('{"aaa": {"metrics": [{"aaa": 9}]}}', '{"rows": [{"metrics": [{"aaa": 1}]}]}', '{"score": {"metrics": [{"score": true}]}}', '{"score": {"metrics": [{"score": null}]}}', '{"score": {"metrics": [{"score": "1"}]}}'):
        with pytest.raises(Exception, match="metric score"):
            metric(spark, bad)
    with pytest.raises(Exception, match="without evaluations"):
        metric(spark, "{}", 0.5)


def test_scores_files_name_their_trials(spark, tmp_path):
    put(tmp_path / "s.json", {"t1": {"trial_id": "t1", "mode": "llm_judge", "reward": 0.5, "rca_accuracy": 1}})
    assert [(r.trial_id, r.reward, r.hallucinate_any) for r in trees.judge_scores(spark, str(tmp_path / "s.json")).collect()] == [("t1", 0.5, None)]
    put(tmp_path / "bad.json", {"t1": {"trial_id": "t2"}})
    with pytest.raises(Exception, match="not a scores file"):
        trees.judge_scores(spark, str(tmp_path / "bad.json")).collect()


def test_configurations_with_unknown_keys_stop_the_run(tmp_path):
    put(tmp_path / "c.yaml", "ttd: 3\nextra: 1\n")
    assert trees.yaml_config(str(tmp_path / "c.yaml"), ["ttd", "extra"]) == {"ttd": 3, "extra": 1}
    with pytest.raises(ValueError, match="unknown keys .* extra"):
        trees.yaml_config(str(tmp_path / "c.yaml"), ["ttd"])


def test_only_the_days_of_a_range_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{k} 12:00:00") for k in range(1, 7)], "k int, at string").select("k", F.col("at").cast("timestamp_ntz").alias("ts"))
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(str(tmp_path / "d"))
    found = trees.day_range(spark, str(tmp_path / "d"), "2024-01-02 12:00:00", "2024-01-04 11:59:59")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan
    assert [r.k for r in found.collect()] == [2, 3]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, [])], "k string, n int, tags array<string>")
    sinks.json_by(rows, str(tmp_path / "j"), "k")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.csv_table(rows, str(tmp_path / "c"))
    assert [r.tags for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("k").collect()] == ["x;y", None]
    assert sinks.markdown(rows.select("k", "n").orderBy("k")) == "| k | n |\n|---|---|\n| a | 1 |\n| b | 2 |"
    with pytest.raises(ValueError):
        sinks.markdown(rows, 1)
    new = spark.createDataFrame([("a", 9, []), ("c", 3, [])], rows.schema)
    assert sorted((r.k, r.n) for r in sinks.upserted(rows, new, ["k"]).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert (sinks.mean_cell(None, None), sinks.mean_cell(22.449, None), sinks.mean_cell(26.61, 3.004)) == ("—", "22.4%", "26.6% ± 3.0%")


def tree_of(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("a/"), F.col("id") % 7, F.lit("/"), "id", F.lit(".txt")).alias("path"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("body é "), "id")).alias("body")).repartition(4)
    for root in (tmp_path / "x", tmp_path / "y"):
        put_files(rows, f"file://{root}" if root.name == "x" else str(root))
        assert tree_of(root) == {f"a/{k % 7}/{k}.txt": f"body é {k}" if k % 5 else "" for k in range(200)}
    put_files(spark.createDataFrame([("a/0/0.txt", bytearray(b"\x00new"))], "path string, body binary"), str(tmp_path / "x"))
    assert (tmp_path / "x/a/0/0.txt").read_bytes() == b"\x00new"
    put_files(rows.limit(0), str(tmp_path / "x"))
    for bad in ("../out", "/etc/x", "", "a/../../b"):
        with pytest.raises(Exception, match="not a path inside the tree"):
            put_files(spark.createDataFrame([(bad, "x")], "path string, body string"), str(tmp_path / "x"))


def test_a_task_that_fails_half_way_leaves_no_file(spark, tmp_path):
    body = F.when(F.col("id") == 70, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.repeat(F.lit("x"), 100_000))
    rows = spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("path"), body.alias("body"))
    with pytest.raises(Exception, match="lost"):
        put_files(rows, str(tmp_path / "tree"))
    assert tree_of(tmp_path / "tree") == {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        with pytest.raises(Exception, match="lost"):
            put_files(rows, str(tmp_path / "tree"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [p for p in tree_of(tmp_path / "tree") if not p.startswith("_staging-")] == []
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "tree")).count() == 0


def test_a_range_opens_its_pages_alone(spark, tmp_path):
    """Pages outside the range are broken: to open one of them fails."""
    stamp = lambda n: f"2024-01-{n:02d}T00:00:00"
    page = lambda n: {"items": [{"id": n * 10 + k, "at": f"2024-01-{n:02d}T{k:02d}:00:00"} for k in range(10)]}
    put(tmp_path / "p-1.json", page(1) | {"total_pages": 9, "bounds": [[stamp(n), f"2024-01-{n:02d}T09:00:00"] for n in range(1, 9)] + [None]})
    for n in range(2, 9):
        put(tmp_path / f"p-{n}.json", page(n) if n in (3, 4) else "{broken")
    put(tmp_path / "p-9.json", {"items": []})
    read = lambda order="at": paged(spark, str(tmp_path / "p-{page}.json"), "id long, at timestamp_ntz", order=order)
    at = F.col("at")
    some = lambda x: F.lit(x).cast("timestamp_ntz")
    assert sorted(r.id for r in read().where((at >= some("2024-01-03T05:00:00")) & (at < some("2024-01-04T02:00:00"))).collect()) == [35, 36, 37, 38, 39, 40, 41]
    assert [r.id for r in read().where(at == some("2024-01-04T03:00:00")).collect()] == [43]
    assert read().where(at > some("2025-01-01T00:00:00")).collect() == []
    assert sorted(r.id for r in read().where(at.isin("2024-01-03T00:00:00", "2024-01-04T09:00:00") & (F.col("id") > 0)).collect()) == [30, 49]
    for rows in (read(), read(None).where(at == some("2024-01-04T03:00:00"))):
        with pytest.raises(Exception, match="JSON|Expecting"):
            rows.collect()


def test_specs_have_ids_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    trees.write_specs(rows, str(tmp_path / "x"), "id")
    assert tree_of(tmp_path / "x") == {"a.json": '{"n":1}', "b.json": "{}"}
    with pytest.raises(Exception, match="repeated key: a"):
        trees.write_specs(rows.union(rows.limit(1)), str(tmp_path / "y"), "id")
    assert [p for p in tree_of(tmp_path / "y") if not p.startswith("_")] == []


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    """Names with spaces and signs, hidden files, blank, marked, broken and repeated JSON; no listing of Spark's own, which brings every name to the driver."""
    from quern.sources import files

    bodies = {"b/t 1%/verifier/report.md": "one", "t2/verifier/report.md": "", "t2/_x/report.md": "no", "b/.t3/report.md": "no", "b/t 1%/config.json": '﻿ {"agent": {"name": "x"}}', "t2/config.json": " \n", "t4/config.json": '[{"agent": {"name": "y"}}, {"agent": {"name": "z"}}]', "t5/config.json": "[", "top.txt": "é"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    seen = [n for n in bodies if "_x" not in n and "/.t3" not in n]
    found = files.listed(spark, f"file://{tmp_path}/")
    assert sorted(r.inside for r in found.collect()) == sorted(seen)
    assert {r.inside: r.value for r in files.bodies(found).collect()} == {n: bodies[n] for n in seen}
    assert sorted(r.inside for r in files.listed(spark, str(tmp_path), deep=False).collect()) == ["top.txt"]
    assert [(r.inside, r.value) for r in files.bodies(files.listed(spark, f"{tmp_path}/top.txt")).collect()] == [("", "é")]
    for tree in (str(tmp_path), found):
        assert sorted((r.trial_id, r.report) for r in trees.reports(spark, tree).collect()) == [("t 1%", "one"), ("t2", "")]
        assert sorted((r.trial_id, r.agent or "-") for r in trees.agent_configs(spark, tree).collect()) == [("t 1%", "x"), ("t4", "y"), ("t4", "z"), ("t5", "-")]
    assert not any("/report.md" in f for f in trees.reports(spark, str(tmp_path)).inputFiles())


def test_a_folder_of_csv_is_written_by_one_task(spark, tmp_path):
    from quern.sources import sinks

    sinks.csv_by(spark.range(40).repartition(5).selectExpr("id % 4 as k", "id"), str(tmp_path / "x"), "k")
    assert [len(list((tmp_path / f"x/k={k}").glob("*.csv"))) for k in range(4)] == [1] * 4
