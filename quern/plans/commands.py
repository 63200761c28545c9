"""Commands of trajectories: classes, languages, tables of labels by group.

Stand-ins: a conversation is a trial, a turn a tool call. What the assistant says is a written-out
command (one of COMMANDS), two times in three with the whole text of the turn behind it; what others
say is a command as it is. Calls of the system's turns are of another tool than the shell. The number
of the conversation gives the agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import stats, trajectory
from quern.plans.registry import Tables, big, query, r6

#: Commands and the labels they are expected to get, written down from the rules' meaning and not from their code.
COMMANDS = [
    ("", "control:wait"),
    ("   ", "control:wait"),
    ("C-c", "control:interrupt"),
    ("C-z ", "control:interrupt"),
    ("c-c", "other"),
    ('echo "READY"', "control:wait"),
    ("printf 'done\\n'", "control:wait"),
    ("clear", "control:wait"),
    ("ls src/", "code:ls"),
    ("ls -la", "code:ls"),
    ("ls api", "other"),
    ("cat src/ad/main.go", "code:read_file"),
    ("head -50 notes", "code:read_file"),
    ("sed -n 1,40p src/cart/a.cs", "code:read_file"),
    ("sed -n 1,40p a.txt", "other"),
    ("grep -rn foo src/", "code:search"),
    ("grep -rn foo lib/", "other"),
    ("rg timeout --glob *.py", "code:search"),
    ("find . -name *.go", "code:find"),
    ("find / -name passwd", "other"),
    ("find src/ | head", "code:find,code:read_file"),
    ("docker-compose config", "code:docker"),
    ("docker compose logs cart", "telemetry:docker_logs"),
    ("docker logs cart", "telemetry:docker_logs"),
    ("docker logs cart; curl $G/api/ds/query -d @q.json", "telemetry:docker_logs,telemetry:grafana_query_unresolved"),
    ("curl loki/loki/api/v1/query; curl $G/api/ds/query", "telemetry:metrics,telemetry:logs"),
    ("docker ps", "code:container_inspect"),
    ("docker exec cart ls", "code:ls,code:container_inspect"),
    ("curl $GRAFANA_URL/api/health", "telemetry:grafana_health"),
    ("curl $GRAFANA_URL/api/datasources", "telemetry:grafana_ds_list"),
    ("curl $G/api/datasources/3/proxy", "other"),
    ("curl $G/api/search?query=x", "telemetry:grafana_dashboard"),
    ("curl localhost:9090/api/v1/query?query=up", "telemetry:metrics"),
    ("echo 'sum(rate(x[5m]))'", "telemetry:metrics"),
    ('q x_total{a="b"} "x_total"', "telemetry:metrics"),
    ("curl $G/api/datasources/proxy/1/api/v1/labels", "telemetry:grafana_ds_list,telemetry:metrics"),
    ("curl $G/api/datasources/proxy/uid/jaeger/api/traces", "telemetry:grafana_ds_list,telemetry:spans"),
    ("curl jaeger:16686/api/services", "telemetry:spans"),
    ("printenv | grep jaeger", "setup:env_discovery"),
    ("curl opensearch:9200/otel-logs/_search", "telemetry:logs"),
    ("curl loki/loki/v1/push", "telemetry:logs"),
    ("curl $G/api/ds/query -d webstore-metrics", "telemetry:metrics"),
    ("curl $G/api/ds/query -d @q.json", "telemetry:grafana_query_unresolved"),
    ("env | grep URL", "setup:env_discovery"),
    ("env", "other"),
    ("echo $GRAFANA_URL", "setup:env_discovery"),
    ("pip install requests", "setup:package_install"),
    ("apt-get update", "setup:package_install"),
    ("date -u", "utility:timestamp"),
    ("date; ls", "code:ls"),
    ("cat /app/report.md", "utility:read_report"),
    ("echo x > /app/report.md", "utility:write_report"),
    ("tee /app/report.md", "utility:write_report"),
    ("cat /tmp/notes.txt", "utility:read_scratch"),
    ("wc -l /tmp/a/b.txt", "utility:read_scratch"),
    ("python -c 'import datetime'", "utility:timestamp"),
    ("python3 -m json.tool", "utility:json_processing"),
    ("python fetch_request.py", "telemetry:grafana_query_unresolved"),
    ("curl http://cart:8080", "telemetry:grafana_query_unresolved"),
    ("ping grafana", "telemetry:grafana_query_unresolved"),
    ("curl cart", "other"),
    ("true", "other"),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_EXPECTED = "(VALUES " + ", ".join(f"({k}, {_quoted(c)}, {_quoted(want)})" for k, (c, want) in enumerate(COMMANDS)) + ") e(k, command, labels)"


def _one_of(**rules: str) -> str:
    return ", ".join(f"CASE WHEN {rule} THEN '{label.replace('__', ':')}' END" for label, rule in rules.items())


def _m(pattern: str, of: str = "cl") -> str:
    return f"regexp_matches({of}, {_quoted(pattern)})"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(cl, {_quoted(w)})" for w in words) + ")"


# The labels of any command, rule by rule, in SQL of their own.
_READ = r"\bcat\b|\bhead\b|\btail\b|\bless\b|\bwc\b|\bnl\b|\bawk\b"
_REPORT, _SCRATCH, _CURL, _KEYS = r"\breport\.md\b", r"/tmp/\S*\.txt\b", r"\bcurl\b", r"^C-[cdz]\s*$"
_QUIET = f"NOT {_has('grep')} AND NOT {_has('printenv')}"
_FOUND = [
    _one_of(code__ls=rf"{_m(r'\bls\b')} AND NOT {_has('api', 'grafana')} AND NOT report"),
    _one_of(code__find=rf"{_m(r'\bfind\b')} AND ({_m(r'\.(go|ts|js|py|java|cs|rb|proto|yaml|yml)')} OR {_has('src/', '/app/opentelemetry-demo')})"),
    _one_of(code__read_file=rf"({_m(_READ)} AND NOT {_has('api')} OR {_m(r'\bsed\b.*src/')}) AND NOT report AND NOT scratch"),
    _one_of(code__search=rf"{_m(r'\b(grep|rg)\b')} AND {_has('src', '.go', '.ts', '.js', '.py', '.java')} AND NOT report"),
    _one_of(code__docker=f"{_m('docker-compose|docker compose')} AND NOT {_m('docker-compose logs|docker compose logs')}"),
    _one_of(code__container_inspect=rf"{_m(r'\bdocker\s+(inspect|exec|ps)\b')} AND NOT {_has('grafana')}"),
    _one_of(telemetry__grafana_health=_has("api/health")),
    _one_of(telemetry__grafana_ds_list=rf"{_m(r'api/datasources\b')} AND NOT {_m(r'api/datasources/\d+/proxy')}"),
    _one_of(telemetry__grafana_dashboard=_m(r"api/search\b|dashboard")),
    _one_of(telemetry__metrics=_m(r"prom|api/v1/query|api/v1/label|rate\(|histogram_quantile|sum\(|avg\(|increase\(|webstore-metrics|datasources/proxy.*api/v1/") + " OR " + _m(r'(_total|_bucket|_count|_sum|_duration)["\s\)]')),
    _one_of(telemetry__spans=f"{_m('traceql|/api/traces|webstore-traces|datasources/proxy.*(jaeger|traces|tempo)')} OR {_m('jaeger|/api/services')} AND {_QUIET}"),
    _one_of(telemetry__logs=f"{_m('webstore-logs|opensearch|loki')} AND {_QUIET}"),
    _one_of(telemetry__docker_logs=_m("docker (compose )?logs|docker-compose logs")),
]
_LATER = [
    _one_of(telemetry__grafana_query_unresolved=f"{_has('api/ds/query')} AND NOT list_has_any(found, ['telemetry:metrics', 'telemetry:spans', 'telemetry:logs'])"),
    _one_of(setup__env_discovery=rf"{_m(r'\bprintenv\b')} OR {_m(r'\benv\b')} AND {_has('grep')}"),
    _one_of(setup__package_install=_m("pip install|apt-get|apt install")),
    _one_of(setup__env_discovery=f"{_has('echo')} AND {_has('grafana_url')}"),
]
_WRITES = r">>?\s*\S*\breport\.md\b|\btee\b\s+\S*\breport\.md\b"
_LAST = [
    _one_of(utility__timestamp=rf"{_m(r'\bdate\b')} AND len(found) = 0"),
    _one_of(utility__write_report=f"report AND {_m(_WRITES)}"),
    _one_of(utility__read_report=f"report AND NOT {_m(_WRITES)}"),
    _one_of(utility__read_scratch=f"scratch AND {_m(_READ + '|' + chr(92) + 'bsed' + chr(92) + 'b')}"),
]
_OTHERWISE = f"""CASE WHEN {_has('python')} AND {_has('datetime', 'timestamp', 'time.time')} THEN 'utility:timestamp' WHEN {_has('python')} AND {_has('json')} THEN 'utility:json_processing'
    WHEN {_has('python')} AND {_has('urllib', 'request')} OR {_m(_CURL)} AND {_has('http')} OR {_has('grafana')} THEN 'telemetry:grafana_query_unresolved' ELSE 'other' END"""
_SENTINEL = "^(?is:(echo|printf)\\s+'?\"?(ready|recovered|done|ok|shell_ok)\\\\?n?'?\"?\\s*)$"
_CONTROL = f"""CASE WHEN raw = '' OR {_m(_SENTINEL, 'raw')} OR {_m('^(?i:clear|reset|enter)$', 'raw')} THEN 'control:wait' WHEN {_m(_KEYS, 'cmd')} THEN 'control:interrupt' END"""
_SOME = "lambda c: c IS NOT NULL"
_CALLS = f"""
    said AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN e.command || CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE ' # ' || coalesce(text, '') END ELSE coalesce(text, '') END AS cmd
      FROM conversations LEFT JOIN {_EXPECTED} ON e.k = (conv_id * 7 + turn) % {len(COMMANDS)}),
    bare AS (SELECT *, lower(cmd) AS cl, trim(cmd, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM said),
    io AS (SELECT *, {_m(_REPORT)} AS report, {_m(_SCRATCH)} AS scratch FROM bare),
    a AS (SELECT *, list_filter([{", ".join(_FOUND)}], {_SOME}) AS found FROM io),
    b AS (SELECT * EXCLUDE (found), found || list_filter([{", ".join(_LATER)}], {_SOME}) AS found FROM a),
    c AS (SELECT * EXCLUDE (found), found || list_filter([{", ".join(_LAST)}], {_SOME}) AS found FROM b),
    calls AS MATERIALIZED (SELECT conv_id, turn, role, text, cmd, coalesce({_CONTROL}, CASE WHEN len(found) > 0 THEN array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') ELSE {_OTHERWISE} END) AS labels FROM c)
"""


def _calls(t: Tables) -> DataFrame:
    said = F.coalesce("text", F.lit(""))
    behind = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" # "), said))
    command = F.when(F.col("role") == "assistant", F.concat(_written(), behind)).otherwise(said)
    return t.conversations.select("conv_id", "turn", "role", "text", command.alias("command")).withColumn("cats", text.classify_command(F.col("command")))


def _written() -> Column:
    script = F.array(*[F.lit(c) for c, _ in COMMANDS])
    return F.element_at(script, ((F.col("conv_id") * 7 + F.col("turn")) % len(COMMANDS) + 1).cast("int"))


def _agent(conv: Column) -> Column:
    return F.concat(F.lit("agent-"), (conv % 3).cast("string"))


@query(f"WITH {_CALLS} SELECT conv_id, turn, labels FROM calls")
def cmd_classify(t: Tables) -> DataFrame:
    return _calls(t).select("conv_id", "turn", F.array_join("cats", ",").alias("labels"))


@query(f"SELECT conv_id, turn, labels FROM conversations JOIN {_EXPECTED} ON e.k = (conv_id * 7 + turn) % {len(COMMANDS)}")
def cmd_expected(t: Tables) -> DataFrame:
    """Written-out commands, one for each turn, with the labels that were written down for them."""
    return t.conversations.select("conv_id", "turn", F.array_join(text.classify_command(_written()), ",").alias("labels"))


@query("""
    SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '\\.yaml\\b|\\.yml\\b') THEN 'YAML' END, CASE WHEN regexp_matches(html, '\\.go\\b') THEN 'Go' END,
      CASE WHEN regexp_matches(html, '\\.ts\\b') THEN 'TypeScript' END, CASE WHEN regexp_matches(html, '\\.js\\b') THEN 'JavaScript' END, CASE WHEN regexp_matches(html, '\\.py\\b') THEN 'Python' END,
      CASE WHEN regexp_matches(html, '\\.java\\b') THEN 'Java' END, CASE WHEN regexp_matches(html, '\\.cs\\b') THEN 'C#' END, CASE WHEN regexp_matches(html, '\\.rb\\b') THEN 'Ruby' END,
      CASE WHEN regexp_matches(html, '\\.php\\b') THEN 'PHP' END, CASE WHEN regexp_matches(html, '\\.rs\\b') THEN 'Rust' END, CASE WHEN regexp_matches(html, '\\.proto\\b') THEN 'Protobuf' END,
      CASE WHEN contains(html, 'Dockerfile') THEN 'Docker' END, CASE WHEN regexp_matches(html, '\\.kt\\b') THEN 'Kotlin' END], lambda x: x IS NOT NULL), ',') AS languages FROM pages
""")
def lang_detect(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(text.languages(F.col("html")), ",").alias("languages"))


@query(f"WITH {_CALLS} SELECT array_to_string(list_sort(list_distinct(list_transform(string_split(labels, ','), lambda x: split_part(x, ':', 1)))), ' + ') AS combination, count(*) AS n FROM calls GROUP BY 1")
def category_overlap(t: Tables) -> DataFrame:
    """Which kinds of labels occur together on one call."""
    return _calls(t).groupBy(text.prefix_combination(F.col("cats")).alias("combination")).agg(F.count(F.lit(1)).alias("n"))


_MAIN = """
    CASE WHEN regexp_matches(labels, 'telemetry:(metrics|spans|logs|docker_logs|grafana_query_unresolved)') THEN 'Telemetry' WHEN contains(labels, 'code:') THEN 'Code'
      WHEN regexp_matches(labels, 'telemetry:grafana_(health|ds_list|dashboard)') THEN 'Discovery' ELSE 'Other' END
"""


@query(f"""
    WITH {_CALLS}, k AS (SELECT conv_id, {_MAIN} AS main FROM calls)
    SELECT conv_id, count(*) FILTER (main = 'Discovery') AS discovery, count(*) FILTER (main = 'Telemetry') AS telemetry, count(*) FILTER (main = 'Code') AS code, count(*) FILTER (main = 'Other') AS other FROM k GROUP BY 1
""")
def category_pivot(t: Tables) -> DataFrame:
    """Calls per trial by main category, one column each."""
    rows = _calls(t).select("conv_id", F.lower(text.main_category(F.col("cats"))).alias("main"))
    return rows.groupBy("conv_id").pivot("main", ["discovery", "telemetry", "code", "other"]).agg(F.count(F.lit(1))).fillna(0)


@query(f"WITH {_CALLS}, x AS (SELECT unnest(string_split(labels, ',')) AS label FROM calls) SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM x)::DOUBLE, 6) AS share FROM x GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    """Labels counted over all calls, with their shares."""
    counts = _calls(t).select(F.explode("cats").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", r6(F.col("n") / counts.select(F.sum("n")).scalar()).alias("share"))


_SIDE = """
    CASE WHEN contains(labels, 'code:') AND contains(labels, 'telemetry:') THEN 'both' WHEN contains(labels, 'code:') THEN 'code' WHEN contains(labels, 'telemetry:') THEN 'telemetry' ELSE 'other' END
"""
_DATA = "regexp_extract(labels, '(telemetry:(?:metrics|spans|logs|docker_logs|grafana_query_unresolved))', 1)"
_LANGUAGES = {r"\.ya?ml\b": "YAML", r"\.go\b": "Go", r"\.ts\b": "TypeScript", r"\.js\b": "JavaScript", r"\.py\b": "Python", r"\.java\b": "Java", r"\.cs\b": "C#", r"\.rb\b": "Ruby", r"\.php\b": "PHP", r"\.rs\b": "Rust", r"\.proto\b": "Protobuf", "Dockerfile": "Docker", r"\.kt\b": "Kotlin"}
_SPOKEN = "[" + ", ".join(f"CASE WHEN {_m(p, 'cmd')} THEN '{name}' END" for p, name in _LANGUAGES.items()) + "]"
_QUARTERS = ", ".join(f"count(*) FILTER (code AND nth >= floor({q} * n / 4) AND nth < floor({q + 1} * n / 4)) / greatest(floor({q + 1} * n / 4) - floor({q} * n / 4), 1)::DOUBLE AS q{q + 1}_code" for q in range(4))
_RUNS = f"""
    {_CALLS}, s AS (SELECT *, {_SIDE} AS side, lag({_SIDE}) OVER w AS before, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY conv_id) AS n, contains(labels, 'code:') AS code FROM calls WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT *, lag(side) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM s WHERE before IS DISTINCT FROM side),
    switches AS (SELECT conv_id, count(*) FILTER ((prev = 'code' AND side = 'telemetry') OR (prev = 'telemetry' AND side = 'code')) AS n_switches FROM k GROUP BY 1),
    spoken AS (SELECT conv_id, string_agg(DISTINCT x, ',' ORDER BY x) AS languages, count(DISTINCT x) AS n_languages FROM (SELECT conv_id, unnest({_SPOKEN}) AS x FROM s) GROUP BY 1),
    whole AS (SELECT conv_id, count(*) AS n_calls FROM conversations GROUP BY 1),
    runs AS (SELECT conv_id, count(*) AS n_commands, arg_min(nullif({_DATA}, ''), turn) FILTER ({_DATA} <> '') AS first_data, arg_min(side, turn) FILTER (side <> 'other') AS starts_with,
      count_if(side IN ('code', 'both')) AS n_code, count_if(side IN ('telemetry', 'both')) AS n_telemetry, {_QUARTERS}, count_if(turn % 4 IN (1, 2)) AS n_errors FROM s GROUP BY conv_id, n)
"""


def _runs(t: Tables) -> DataFrame:
    """The analysis of each run over its shell calls: languages, first telemetry query, sides and switches, shares, density of code in each quarter, errors. Other tools' calls count in n_calls alone."""
    every = _calls(t)
    output = F.concat(F.coalesce("text", F.lit("")), F.lit("\nProcess exited with code "), (F.col("turn") % 4).cast("string"))
    rows = every.where("role <> 'system'").select("conv_id", "turn", "cats", text.side(F.col("cats")).alias("side"), text.languages(F.col("command")).alias("languages"), text.exit_error(output).alias("failed"))
    w = Window.partitionBy("conv_id")
    code, tele = F.col("side").isin("code", "both"), F.col("side").isin("telemetry", "both")
    data = F.filter("cats", lambda c: c.isin(*text.TELEMETRY_DATA))
    placed = trajectory.numbered(rows, ["conv_id"], ["turn"]).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("quarter", trajectory.quarter(F.col("pos"), F.col("n")))
    density = lambda q: F.coalesce(F.avg(F.when(F.col("quarter") == q, code.cast("double"))), F.lit(0.0)).alias(f"q{q + 1}_code")
    per = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_commands"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"),
        F.min_by(F.get(data, F.lit(0)), F.when(F.size(data) > 0, F.col("turn"))).alias("first_data"),
        F.min_by("side", F.when(F.col("side") != "other", F.col("turn"))).alias("starts_with"),
        F.count_if(code).alias("n_code"),
        F.count_if(tele).alias("n_telemetry"),
        *map(density, range(4)),
        F.count_if("failed").alias("n_errors"),
    )
    runs = trajectory.collapsed(rows, ["conv_id"], ["turn"], "side").withColumn("prev", F.lag("side").over(w.orderBy("turn")))
    flip = ((F.col("prev") == "code") & (F.col("side") == "telemetry")) | ((F.col("prev") == "telemetry") & (F.col("side") == "code"))
    whole = every.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"))
    return whole.join(per, "conv_id").join(runs.groupBy("conv_id").agg(F.count_if(flip).alias("n_switches")), "conv_id")


@query(f"""
    WITH {_RUNS} SELECT conv_id, n_calls, n_commands, coalesce(languages, '') AS languages, n_languages, first_data, starts_with, n_switches, n_code, n_telemetry, round(n_code / n_commands::DOUBLE, 6) AS code_share, round(n_telemetry / n_commands::DOUBLE, 6) AS telemetry_share,
      round(q1_code, 6) AS q1_code, round(q2_code, 6) AS q2_code, round(q3_code, 6) AS q3_code, round(q4_code, 6) AS q4_code, n_errors, round(n_errors / n_commands::DOUBLE, 6) AS error_rate
    FROM whole JOIN runs USING (conv_id) JOIN switches USING (conv_id) JOIN spoken USING (conv_id)
""")
def run_analysis(t: Tables) -> DataFrame:
    """One row per run: languages, its first telemetry query, the side it starts with, switches between sides, shares, density of code in each quarter, errors."""
    share = lambda c: r6(F.col(c) / F.col("n_commands"))
    cells = [r6(F.col(f"q{q}_code")).alias(f"q{q}_code") for q in range(1, 5)]
    whole = ["conv_id", "n_calls", "n_commands", F.array_join("languages", ",").alias("languages"), big(F.size("languages")).alias("n_languages"), "first_data", "starts_with", "n_switches", "n_code", "n_telemetry"]
    return _runs(t).select(*whole, share("n_code").alias("code_share"), share("n_telemetry").alias("telemetry_share"), *cells, "n_errors", share("n_errors").alias("error_rate"))


@query(f"""
    WITH {_RUNS} SELECT 'agent-' || (conv_id % 3) AS agent, count(*) AS n_runs, round(avg(n_calls), 6) AS mean_calls, round(avg(n_switches), 6) AS mean_switches, round(avg(n_code / n_commands::DOUBLE), 6) AS mean_code,
      CAST(count_if(starts_with = 'code') AS BIGINT) AS n_code_first, round(100.0::DOUBLE * count_if(starts_with = 'code') / count(*), 6) AS pct_code_first, round(median(n_calls)::DOUBLE, 6) AS median_calls, max(n_calls) AS most_calls
    FROM whole JOIN runs USING (conv_id) JOIN switches USING (conv_id) GROUP BY 1
""")
def run_summary(t: Tables) -> DataFrame:
    """Means of per-run measures by group, shares with their counts, the median and the largest run."""
    rows = _runs(t).withColumn("agent", _agent(F.col("conv_id")))
    first = F.count_if(F.coalesce(F.col("starts_with") == "code", F.lit(False)))
    return rows.groupBy("agent").agg(
        F.count(F.lit(1)).alias("n_runs"),
        r6(F.avg("n_calls")).alias("mean_calls"),
        r6(F.avg("n_switches")).alias("mean_switches"),
        r6(F.avg(F.col("n_code") / F.col("n_commands"))).alias("mean_code"),
        first.alias("n_code_first"),
        r6(100.0 * first / F.count(F.lit(1))).alias("pct_code_first"),
        r6(F.median("n_calls")).alias("median_calls"),
        F.max("n_calls").alias("most_calls"),
    )


# Judged telemetry calls: the verdict is the stand-in's length of text, a call without text was not judged.
_JUDGED = f"""
    {_CALLS}, judged AS (SELECT conv_id, turn, 'agent-' || (conv_id % 3) AS agent, CASE WHEN contains(labels, 'telemetry:metrics') THEN 'metrics' WHEN regexp_matches(labels, 'telemetry:(logs|docker_logs)') THEN 'logs' WHEN contains(labels, 'telemetry:spans') THEN 'traces' END AS kind,
      CASE length(text) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'empty' WHEN 2 THEN 'error' END AS label FROM calls WHERE contains(labels, 'telemetry:') AND conv_id % 10 <> 9)
"""


def _judged(t: Tables) -> DataFrame:
    """Telemetry calls with their verdicts, mapped to groups; conversations ending in 9 have no group."""
    n = F.char_length("text") % 4
    label = F.when(n == 0, "success").when(n == 1, "empty").when(n == 2, "error")
    calls = _calls(t).where(text.is_telemetry(F.col("cats"))).select("conv_id", "turn", text.telemetry_type(F.col("cats")).alias("kind"), label.alias("label"))
    groups = t.conversations.select("conv_id").distinct().where("conv_id % 10 <> 9").select("conv_id", _agent(F.col("conv_id")).alias("agent"))
    return calls.join(groups, "conv_id")


@query(f"""
    WITH {_JUDGED} SELECT agent, coalesce(kind, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE 'none' END) AS kind, count(*) FILTER (label = 'success') AS success, count(*) FILTER (label = 'empty') AS empty, count(*) FILTER (label = 'error') AS error, count(*) FILTER (label IS NULL) AS unjudged
    FROM judged GROUP BY GROUPING SETS ((agent), (agent, kind))
""")
def telemetry_labels(t: Tables) -> DataFrame:
    """Verdicts per group, and per group and type of telemetry, by grouping sets in one pass."""
    by = _judged(t).groupingSets([["agent"], ["agent", "kind"]], "agent", "kind")
    cell = lambda x: F.count_if(F.coalesce(F.col("label") == x, F.lit(False))).alias(x)
    rows = by.agg(cell("success"), cell("empty"), cell("error"), F.count_if(F.col("label").isNull()).alias("unjudged"), F.grouping("kind").alias("g"))
    return rows.select("agent", F.coalesce("kind", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.lit("none"))).alias("kind"), "success", "empty", "error", "unjudged")


@query(f"""
    WITH {_JUDGED}, per AS (SELECT agent, conv_id, count(label) AS n FROM judged GROUP BY ALL)
    SELECT agent, count(*) AS n_trials, round(avg(n), 6) AS mean_calls, round(coalesce(stddev_samp(n), 0), 6) AS std_calls FROM per GROUP BY 1
""")
def calls_spread(t: Tables) -> DataFrame:
    """Mean and standard deviation of judged calls per trial (0 for a single trial)."""
    per = _judged(t).groupBy("agent", "conv_id").agg(F.count("label").alias("n"))
    return per.groupBy("agent").agg(F.count(F.lit(1)).alias("n_trials"), r6(F.avg("n")).alias("mean_calls"), r6(F.coalesce(F.stddev_samp("n"), F.lit(0.0))).alias("std_calls"))


@query(f"""
    WITH {_CALLS}, t AS (SELECT conv_id, count(*) AS n FROM calls WHERE contains(labels, 'telemetry:') GROUP BY 1)
    SELECT count(*) FILTER (conv_id % 10 <> 9) AS n_mapped, count(*) FILTER (conv_id % 10 = 9) AS n_unmapped FROM t
""")
def unmapped_trials(t: Tables) -> DataFrame:
    """Trials with telemetry calls that have a group, and those that have none (an anti join)."""
    trials = _calls(t).where(text.is_telemetry(F.col("cats"))).select("conv_id").distinct()
    groups = t.conversations.select("conv_id").distinct().where("conv_id % 10 <> 9").withColumn("known", F.lit(True))
    return trials.join(groups, "conv_id", "left").agg(F.count("known").alias("n_mapped"), F.count_if(F.col("known").isNull()).alias("n_unmapped"))


@query(f"""
    WITH {_CALLS}, x AS (SELECT 'agent-' || (conv_id % 3) AS agent, unnest(string_split(labels, ',')) AS label FROM calls), n AS (SELECT agent, label, count(*) AS n FROM x GROUP BY ALL)
    SELECT label, CAST(sum(n) AS BIGINT) AS total, string_agg(agent, ',' ORDER BY n DESC, agent) AS agents, CAST(row_number() OVER (ORDER BY sum(n) DESC, label) AS INT) AS place FROM n GROUP BY 1
""")
def labels_over_groups(t: Tables) -> DataFrame:
    """All labels of all groups, the most frequent first, with the groups that have them (at most one row per label)."""
    n = _calls(t).select(_agent(F.col("conv_id")).alias("agent"), F.explode("cats").alias("label")).groupBy("agent", "label").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "agent")))
    per = n.groupBy("label").agg(F.sum("n").alias("total"), F.array_join(F.transform(order, lambda x: x["agent"]), ",").alias("agents"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "label")))


@query("""
    SELECT conv_id, count(*) AS n_batches, CAST(max(size) AS BIGINT) AS largest FROM (
      SELECT conv_id, (n - 1) // 3 + 1 AS batch, count(*) AS size FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY ALL) GROUP BY 1
""")
def work_batches(t: Tables) -> DataFrame:
    """Work cut into batches of three, numbered from 1."""
    rows = trajectory.batches(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], 3)
    return rows.groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_batches"), F.max("n").alias("largest"))


@query("""
    SELECT conv_id, turn, CASE WHEN contains(coalesce(text, ''), 'Process exited with code 1') OR contains(coalesce(text, ''), 'Process exited with code 2') THEN true ELSE false END AS failed,
      CASE role WHEN 'user' THEN trim(coalesce(text, ''), chr(10)) WHEN 'assistant' THEN 'ls' ELSE '' END = '' AS blank FROM conversations
""")
def shell_calls(t: Tables) -> DataFrame:
    """Shell commands by the tool's name, and whether their output tells of a failure."""
    name = F.when(F.col("role") == "user", "bash_command").when(F.col("role") == "assistant", "exec_command").otherwise("read")
    command = text.shell_command(name, F.lit("ls"), F.col("text"))
    return t.conversations.select("conv_id", "turn", text.exit_error(F.col("text")).alias("failed"), (F.trim(command) == "").alias("blank"))


def _bins(t: Tables) -> DataFrame:
    n = t.conversations.groupBy(_agent(F.col("conv_id")).alias("agent"), "conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n


@query("""
    WITH n AS (SELECT 'agent-' || (conv_id % 3) AS agent, conv_id, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT agent, count(*) AS n_trials, round(median(n)::DOUBLE, 6) AS median_calls, round(avg(n), 6) AS mean_calls, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem_calls FROM n GROUP BY 1
""")
def calls_by_group(t: Tables) -> DataFrame:
    """Calls per trial by group: median, mean and standard error."""
    n, mean, sem = stats.mean_sem(F.col("n"))
    return _bins(t).groupBy("agent").agg(n.alias("n_trials"), r6(F.median("n")).alias("median_calls"), r6(mean).alias("mean_calls"), r6(sem).alias("sem_calls"))
