"""Column functions on names, commands, logs and JSON text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that name a series of a metric family, in the order in which they are tried.
METRIC_SUFFIXES = ["_count", "_sum", "_bucket", "_total", "_created", "_avg", "_max", "_min"]

# Model names as providers prefix them (the first that fits is dropped), their order on boards, short names.
PROVIDER_PREFIXES = ["openai-", "gradient_ai/openai-", "gradient_ai/anthropic-", "gradient_ai/"]
VENDOR_PREFIXES = ["anthropic-", "openai-", "google-", "meta-", "mistral-"]
MODEL_ORDER = ["opus", "sonnet", "gpt", "glm", "deepseek"]
MODEL_ALIASES = {"claude-4.6-sonnet": "Sonnet 4.6", "claude-opus-4.7": "Opus 4.7", "gpt-5.5": "GPT-5.5", "glm-5": "GLM-5", "deepseek-v4-pro": "DeepSeek-V4-Pro"}
GRANULARITY = {"easy": "easy", "hard": "medium", "universal": "hard"}
LAYERS = {"root_cause": 0, "propagation": 1, "symptom": 2, "meta": 3, "unknown": 99}

# Commands that only drive the terminal. They are matched on the whole command.
WAITS = [r"(?s)^\s*$", r"""(?i)^\s*(echo|printf)\s+'?"?(ready|recovered|done|ok|shell_ok)\\?n?'?"?\s*$""", r"(?i)^\s*(clear|reset|enter)\s*$"]
INTERRUPT = r"^C-[cdz]\s*$"

_REPORT = r"\breport\.md\b"
_SCRATCH = r"/tmp/\S*\.txt\b"
_READERS = r"\bcat\b|\bhead\b|\btail\b|\bless\b|\bwc\b|\bnl\b|\bawk\b"

# Fixed values: (label, patterns that must all be found, patterns none of which may be), on the
# lower-cased command. They stay inside what Java's regular expressions and RE2 share.
COMMAND_RULES = [
    ("code:ls", [r"\bls\b"], ["api", "grafana", _REPORT]),
    ("code:find", [r"\bfind\b", r"\.(go|ts|js|py|java|cs|rb|proto|yaml|yml)|src/|/app/opentelemetry-demo"], []),
    ("code:read_file", [_READERS], ["api", _REPORT, _SCRATCH]),
    ("code:read_file", [r"\bsed\b.*src/"], [_REPORT, _SCRATCH]),
    ("code:search", [r"\bgrep\b|\brg\b", r"src|\.go|\.ts|\.js|\.py|\.java"], [_REPORT]),
    ("code:docker", [r"docker-compose|docker compose"], [r"docker-compose logs|docker compose logs"]),
    ("code:container_inspect", [r"\bdocker\s+(inspect|exec|ps)\b"], ["grafana"]),
    ("telemetry:grafana_health", [r"api/health"], []),
    ("telemetry:grafana_ds_list", [r"api/datasources\b"], [r"api/datasources/\d+/proxy"]),
    ("telemetry:grafana_dashboard", [r"api/search\b|dashboard"], []),
    ("telemetry:metrics", [r"prometheus|prom|api/v1/query|api/v1/label"], []),
    ("telemetry:metrics", [r"rate\(|histogram_quantile|sum\(|avg\(|increase\("], []),
    ("telemetry:metrics", [r'_total["\s\)]|_bucket["\s\)]|_count["\s\)]|_sum["\s\)]|_duration["\s\)]'], []),
    ("telemetry:metrics", [r"webstore-metrics"], []),
    ("telemetry:metrics", [r"datasources/proxy.*api/v1/"], []),
    ("telemetry:spans", [r"traceql|/api/traces"], []),
    ("telemetry:spans", [r"webstore-traces"], []),
    ("telemetry:spans", [r"jaeger|/api/services"], ["grep", "printenv"]),
    ("telemetry:spans", [r"datasources/proxy.*(?:jaeger|traces|tempo)"], []),
    ("telemetry:logs", [r"webstore-logs|opensearch"], ["grep", "printenv"]),
    ("telemetry:logs", [r"loki|/loki/"], ["grep", "printenv"]),
    ("telemetry:docker_logs", [r"docker logs|docker-compose logs|docker compose logs"], []),
    ("telemetry:grafana_query_unresolved", [r"api/ds/query"], []),
    ("setup:env_discovery", [r"\bprintenv\b"], []),
    ("setup:env_discovery", [r"\benv\b", r"grep|GRAFANA"], []),
    ("setup:package_install", [r"pip install|apt-get|apt install"], []),
    ("setup:env_discovery", ["echo", "grafana_url"], []),
]
# Rules after those; the first only where nothing above was found.
LATE_RULES = [
    ("utility:timestamp", [r"\bdate\b"], []),
    ("utility:write_report", [_REPORT, r">>?\s*\S*\breport\.md\b|\btee\b\s+\S*\breport\.md\b"], []),
    ("utility:read_report", [_REPORT], [r">>?\s*\S*\breport\.md\b|\btee\b\s+\S*\breport\.md\b"]),
    ("utility:read_scratch", [_SCRATCH, _READERS + r"|\bsed\b"], []),
]
# Where no rule above fits, the first of these that does.
LAST_RESORT = [
    ("utility:timestamp", ["python", r"datetime|timestamp|time\.time"]),
    ("utility:json_processing", ["python", "json"]),
    ("telemetry:grafana_query_unresolved", ["python", "urllib|request"]),
    ("telemetry:grafana_query_unresolved", [r"\bcurl\b", "http"]),
    ("telemetry:grafana_query_unresolved", ["grafana"]),
]
# Labels that are queries of telemetry and that are looks for where it is.
TELEMETRY_DATA = ["telemetry:metrics", "telemetry:spans", "telemetry:logs", "telemetry:docker_logs", "telemetry:grafana_query_unresolved"]
TELEMETRY_DISCOVERY = ["telemetry:grafana_health", "telemetry:grafana_ds_list", "telemetry:grafana_dashboard"]
TELEMETRY_TYPES = {"metrics": ["telemetry:metrics"], "logs": ["telemetry:logs", "telemetry:docker_logs"], "traces": ["telemetry:spans"]}

# Fixed values: (language, pattern) of files that a command touches; case counts.
LANGUAGE_RULES = [
    ("YAML", r"\.yaml\b|\.yml\b"),
    ("Go", r"\.go\b"),
    ("TypeScript", r"\.ts\b"),
    ("JavaScript", r"\.js\b"),
    ("Python", r"\.py\b"),
    ("Java", r"\.java\b"),
    ("C#", r"\.cs\b"),
    ("Ruby", r"\.rb\b"),
    ("PHP", r"\.php\b"),
    ("Rust", r"\.rs\b"),
    ("Protobuf", r"\.proto\b"),
    ("Docker", r"Dockerfile"),
    ("Kotlin", r"\.kt\b"),
]

def _holds(text: Column, all_of: Sequence[str], none_of: Sequence[str] = ()) -> Column:
    out = F.lit(True)
    for p in all_of:
        out = out & text.rlike(p)
    for p in none_of:
        out = out & ~text.rlike(p)
    return out


def _labels(text: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(_holds(text, a, n), F.lit(label)) for label, a, n in rules])))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x computed once, however often it is used."""
    return F.transform(F.array(x), then)[0]


def classify_command(command: Column) -> Column:
    """What a shell command does: labels in the order of the rules, once each; a command that only drives the terminal is nothing else."""

    def early(raw: Column) -> Column:
        control = F.when(raw.rlike(INTERRUPT), F.lit("control:interrupt")).when(raw.rlike(WAITS[0]) | raw.rlike(WAITS[1]) | raw.rlike(WAITS[2]), F.lit("control:wait"))
        return _let(control, lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(_let(F.lower(raw), rules)))

    def rules(low: Column) -> Column:
        last = F.coalesce(*[F.when(_holds(low, a), F.lit(label)) for label, a in LAST_RESORT], F.lit("other"))
        found = _let(_labels(low, COMMAND_RULES), lambda f: _let(told(f), lambda g: F.concat(g, late(low, g))))
        return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(last)))

    def told(found: Column) -> Column:
        # A query through the generic endpoint is unresolved only if nothing tells what it asked for.
        return F.when(F.arrays_overlap(found, F.array(*map(F.lit, TELEMETRY_DATA[:3]))), F.array_remove(found, "telemetry:grafana_query_unresolved")).otherwise(found)

    def late(low: Column, found: Column) -> Column:
        return _let(_labels(low, LATE_RULES), lambda x: F.when(F.size(found) > 0, F.array_remove(x, "utility:timestamp")).otherwise(x))

    return _let(F.coalesce(command, F.lit("")), early)


def languages(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(label)) for label, p in LANGUAGE_RULES]))


def _any_label(labels: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, wanted)))


def is_code(labels: Column) -> Column:
    return F.exists(labels, lambda x: x.startswith("code:"))


def is_telemetry(labels: Column) -> Column:
    return _any_label(labels, TELEMETRY_DATA + TELEMETRY_DISCOVERY)


def side(labels: Column) -> Column:
    """code, telemetry, both or other."""
    code, telemetry = is_code(labels), is_telemetry(labels)
    return F.when(code & telemetry, F.lit("both")).when(code, F.lit("code")).when(telemetry, F.lit("telemetry")).otherwise(F.lit("other"))


def main_category(labels: Column) -> Column:
    """One category for a set of labels: telemetry queries before code before discovery before the rest."""
    return F.when(_any_label(labels, TELEMETRY_DATA), F.lit("Telemetry")).when(is_code(labels), F.lit("Code")).when(_any_label(labels, TELEMETRY_DISCOVERY), F.lit("Discovery")).otherwise(F.lit("Other"))


def telemetry_type(labels: Column) -> Column:
    """metrics, logs or traces: the first whose labels are among these; null if none."""
    return F.coalesce(*[F.when(_any_label(labels, wanted), F.lit(kind)) for kind, wanted in TELEMETRY_TYPES.items()], F.lit(None).cast("string"))


def shell_command(function: Column, cmd: Column, keystrokes: Column) -> Column:
    """The command of a shell tool call by the tool's name; keystrokes without the line ends that close them."""
    typed = F.regexp_replace(F.coalesce(keystrokes, F.lit("")), "\\n+$", "")
    return F.when(function == "exec_command", F.coalesce(cmd, F.lit(""))).when(function == "bash_command", typed).otherwise(F.lit(""))


def prefix_combination(labels: Column) -> Column:
    """The distinct label prefixes, sorted, joined by ' + '."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.substring_index(x, ":", 1)))), " + ")


def family(metric: Column) -> Column:
    """A metric's family: one series suffix dropped, unless it is the whole name. No suffix ends another, so their order makes no difference."""
    return F.regexp_replace(metric, rf"(?s)^(.+)(?:{'|'.join(METRIC_SUFFIXES)})$", "$1")


def strip(text: Column) -> Column:
    """A text without white space (line ends too) at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column) -> Column:
    """Lower case, anything but letters and digits as single dashes, none at the ends; null as 'none'."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("none"))


def short_digest(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def without_prefix(name: Column, prefixes: Sequence[str]) -> Column:
    """name without the first of the prefixes that it has."""
    return F.coalesce(*[F.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1))) for p in prefixes], name)


def model_name(model: Column) -> Column:
    """A model's name without what its provider puts before it."""
    return without_prefix(model, PROVIDER_PREFIXES)


def display_name(model: Column) -> Column:
    """The last path segment without vendor, trailing date and preview tag."""
    out = without_prefix(F.substring_index(model, "/", -1), VENDOR_PREFIXES)
    for tail in (r"-\d{4}-\d{2}-\d{2}$", r"-\d{8}$", r"-(preview|latest|beta|exp)$"):
        out = F.regexp_replace(out, tail, "")
    return out


def aliased(name: Column, names: dict[str, str]) -> Column:
    """The short form of a name where there is one."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)


def model_rank(name: Column) -> Column:
    """(place among the known models, name) to sort by: the unknown come last, by name."""
    low = F.lower(name)
    place = F.coalesce(*[F.when(F.contains(low, F.lit(token)), F.lit(k)) for k, token in enumerate(MODEL_ORDER)], F.lit(len(MODEL_ORDER)))
    return F.struct(place.alias("place"), low.alias("name"))


def layer_rank(layer: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair]), layer), F.lit(99))


def group_label(agent: Column, model: Column, effort: Column) -> Column:
    """agent (model) and, if there is an effort, (effort)."""
    base = F.concat(agent, F.lit(" ("), display_name(model), F.lit(")"))
    return F.when(F.coalesce(effort, F.lit("")) != "", F.concat(base, F.lit(" ("), effort, F.lit(")"))).otherwise(base)


def model_of_label(label: Column) -> Column:
    """The short model name in a group label; the whole label if it has no parentheses."""
    inner = F.regexp_extract(label, r"\(([^)]*)\)", 1)
    return F.when(label.rlike(r"\([^)]*\)"), aliased(inner, MODEL_ALIASES)).otherwise(label)


def joined_model(provider: Column, name: Column) -> Column:
    """provider/name; the bare name if the provider is missing or unknown."""
    known = (F.coalesce(provider, F.lit("")) != "") & (provider != "unknown")
    return F.when(known, F.concat(provider, F.lit("/"), name)).otherwise(name)


def last_segment(link: Column) -> Column:
    """What a link ends in, slashes at the end aside."""
    return F.substring_index(F.regexp_replace(link, "/+$", ""), "/", -1)


def run_name(name: Column) -> Column:
    """(task_type, task_idx, lag, avail) of a run's name, its hash dropped; empty where it has another form."""
    plain, form = F.regexp_replace(name, r"__\w+$", ""), r"^(\w+(?:-\w+)*?)-(\d+)-(lag\w+)-(avail\w+)"
    return F.struct(*[F.regexp_extract(plain, form, k + 1).alias(f) for k, f in enumerate(("task_type", "task_idx", "lag", "avail"))])


def exit_error(output: Column) -> Column:
    """Whether a call's output says that the process failed (codes that begin with these digits included)."""
    body = F.coalesce(output, F.lit(""))
    return F.contains(body, F.lit("Process exited with code 1")) | F.contains(body, F.lit("Process exited with code 2"))


#: One item of a list as Python writes it, and a whole list (a comma may follow the last item).
_ITEM = r"""(?:'(?:[^'\\\n]|\\[\s\S])*+'|"(?:[^"\\\n]|\\[\s\S])*+"|None|True|False|[-+]?[0-9][0-9.eE+-]*)"""
_LIST = rf"^\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*+(?:,\s*)?)?\]$"
#: What stands for what after a backslash, besides numbers of characters.
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}


def _unescaped(body: Column) -> Column:
    parts = F.regexp_extract_all(body, F.lit(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for k, v in _ESCAPES.items() for x in (k, v)])

    def shown(part: Column) -> Column:
        kind, digits = F.substring(part, 2, 1), F.substr(part, F.lit(3))
        of = lambda hexadecimal: F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")
        coded = F.when(kind.isin("x", "u", "U"), of(digits)).when(kind.rlike("^[0-7]$"), of(F.conv(F.substr(part, F.lit(2)), 8, 16)))
        return F.when(~part.startswith("\\"), part).otherwise(F.coalesce(coded, F.try_element_at(known, kind), part))

    return F.array_join(F.transform(parts, shown), "")


def _list_text(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit("")), F.lit(" \t\r\n"))


def parsed_list(cell: Column) -> Column:
    """A list written as Python writes it, its strings without their quotes and escapes, numbers and truth values as text, None as null; anything else is the empty list (`malformed_list` tells it from one)."""
    inside = _list_text(cell)
    items = F.regexp_extract_all(inside, F.lit(_ITEM), F.lit(0))
    bare = lambda x: _unescaped(F.substr(x, F.lit(2), F.length(x) - 2))
    read = F.transform(items, lambda x: F.when(x.rlike("""^['"]"""), bare(x)).when(x != "None", x))
    return F.when(inside.rlike(_LIST), read).otherwise(F.array().cast("array<string>"))


def malformed_list(cell: Column) -> Column:
    """Whether a cell says something, but no list: neither blank nor none nor nan, in letters of any case."""
    inside = _list_text(cell)
    return ~inside.rlike(_LIST) & ~F.lower(inside).isin("", "none", "nan")


def written_list(items: Column) -> Column:
    """A list of strings as Python writes it: in single quotes, or in double ones where that saves escapes, with what has no shape of its own as escapes; null as None."""
    shapes = F.create_map(*map(F.lit, ("\\", "\\\\", "\n", "\\n", "\r", "\\r", "\t", "\\t")))

    def shown(part: Column) -> Column:
        return F.when(part.rlike(r"^[^\\\x00-\x1f\x7f]"), part).otherwise(F.coalesce(F.try_element_at(shapes, part), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(part)), 2, "0")))))

    def quoted(item: Column) -> Column:
        body = F.array_join(F.transform(F.regexp_extract_all(item, F.lit(r"[\\\x00-\x1f\x7f]|[^\\\x00-\x1f\x7f]+"), F.lit(0)), shown), "")
        double = F.contains(item, F.lit("'")) & ~F.contains(item, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(quoted(x), F.lit("None"))), ", "), F.lit("]"))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template's {name} places filled in, null as nothing; doubled braces stand for themselves, unknown names stay as they are."""
    import re

    out: list[Column] = []
    for part in re.split(r"(\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\})", template):
        if part in ("{{", "}}"):
            out.append(F.lit(part[0]))
        elif part[:1] == "{" and part[1:-1] in values:
            out.append(F.coalesce(values[part[1:-1]].cast("string"), F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out) if out else F.lit("")


def printable(text: Column) -> Column:
    """Text without terminal escape sequences and control characters that XML forbids."""
    return F.regexp_replace(F.regexp_replace(text, "\\x1b\\[[0-9;?]*[a-zA-Z]", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def fenced_json(text: Column) -> Column:
    """The JSON inside a fenced block if there is one, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def section(text: Column, title: str) -> Column:
    """The body of a '## title' section of a Markdown text, up to the next one or the end."""
    return strip(F.regexp_extract(text, rf"(?s)(?:^|\n)## {title}[^\n]*\n(.*?)(?=\n## |\z)", 1))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys sorted: a key for grouping and joining."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts stands in a text, whatever their case."""
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower(text), p))
