"""Rubrics as Markdown, whole, from nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal layers in the order in which they are shown, and what is said of each.
LAYERS = {
    "root_cause": "metric closest to the fault injection point",
    "propagation": "intermediate services reflecting the error through the call chain",
    "symptom": "user-facing impact visible to end users or clients",
    "meta": "feature flag counters or internal plumbing",
    "unknown": "unclassified",
}
#: A column of a table is at least this much wider than its heading.
PADDING = 2


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _told(value: Column, *parts: Column | str) -> Column:
    """A paragraph of parts, where there is a value."""
    return F.when(F.coalesce(value, F.lit("")) != "", _text(*parts, "\n\n")).otherwise(F.lit(""))


def _each(items: Column, show) -> Column:
    """What show makes of every item, one after another; nothing for no items."""
    return F.coalesce(F.array_join(F.transform(items, show), ""), F.lit(""))


def _some(items: Column, body: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, body).otherwise(F.lit(""))


def table(headings: Sequence[str], rows: Column) -> Column:
    """Rows (arrays of text) as a table with columns of even width, and an empty line."""
    longest = lambda j: F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(r[j]))), F.lit(0))
    widths = [F.greatest(F.lit(len(h) + PADDING), longest(j)) for j, h in enumerate(headings)]
    line = lambda cells: _text(*[p for c, w in zip(cells, widths) for p in ("| ", F.rpad(c, w, F.lit(" ")), " ")], "|\n")
    rule = _text(*[p for w in widths for p in ("|", F.repeat(F.lit("-"), w + 2))], "|\n")
    return _text(line([F.lit(h) for h in headings]), rule, _each(rows, lambda r: line([r[j] for j in range(len(headings))])), "\n")


def _onset(seconds: Column) -> Column:
    return F.when(seconds.isNull(), F.lit("N/A")).otherwise(_text("+", seconds, "s"))


def _earliest(variants: Column) -> Column:
    return F.array_min(F.transform(variants, lambda v: v["onset_offset_seconds"]))


def _family(family: Column) -> Column:
    labels = F.array_join(F.map_values(family["defining_labels"]), ", ")
    shown = F.when(F.coalesce(labels, F.lit("")) != "", _text(" (", labels, ")")).otherwise(F.lit(""))
    first = F.get(family["variants"], F.lit(0))["description"]
    variants = _each(family["variants"], lambda v: _text("- **", v["type"], "** (onset: ", _onset(v["onset_offset_seconds"]), ")\n  `", v["query"], "`\n\n"))
    return _text("#### ", family["metric_family"], " family", shown, " — onset: ", _onset(_earliest(family["variants"])), "\n\n", _told(first, first), variants)


def _layer(families: Column, name: str, said: str) -> Column:
    own = F.filter(families, lambda f: F.coalesce(f["signal_layer"], F.lit("unknown")) == name)
    onset = F.array_min(F.transform(own, lambda f: _earliest(f["variants"])))
    when = F.when(onset.isNotNull(), _text(" (earliest onset: ", _onset(onset), ")")).otherwise(F.lit(""))
    return _some(own, _text(f"**{name.replace('_', ' ').title()}** — {said}", when, "\n\n", _each(own, _family)))


def _cluster(cluster: Column, unit: str) -> Column:
    count = F.when(cluster["count"].isNotNull(), _text(" (", cluster["count"], f" {unit})")).otherwise(F.lit(""))
    return _text("#### ", F.coalesce(cluster["name"], F.lit("Unknown")), count, "\n\n", _told(cluster["description"], cluster["description"]), _told(cluster["cause"], "**Cause:** ", cluster["cause"]))


def _code(c: Column) -> Column:
    return _text("`", c, "`")


def _log(cluster: Column) -> Column:
    attributes = F.map_entries(cluster["representative_attributes"])
    rows = F.transform(attributes, lambda e: F.array(_code(e["key"]), _code(e["value"])))
    documents = F.transform(cluster["log_documents"], lambda d: F.array(_code(d["_index"]), _code(d["_id"]), d["@timestamp"]))
    return _text(
        _cluster(cluster, "entries"),
        _told(cluster["source"], "**Source:** ", cluster["source"]),
        _some(attributes, _text("**Representative attributes:**\n\n", table(["Field", "Value"], rows))),
        _some(documents, _text("**Log documents:**\n\n", table(["_index", "_id", "@timestamp"], documents))),
    )


def _trace(cluster: Column) -> Column:
    found = cluster["trace_documents"]
    acted = F.exists(found, lambda d: d["user_action"].isNotNull())
    plain = table(["traceID", "@timestamp"], F.transform(found, lambda d: F.array(_code(d["traceID"]), d["@timestamp"])))
    wide = table(["traceID", "@timestamp", "user_action"], F.transform(found, lambda d: F.array(_code(d["traceID"]), d["@timestamp"], F.coalesce(d["user_action"], F.lit("")))))
    return _text(
        _cluster(cluster, "traces"),
        _told(cluster["call_chain"], "**Call chain:**\n\n```\n", cluster["call_chain"], "\n```"),
        _some(cluster["smoking_gun"], _text("**Smoking-gun error messages:**\n\n", _each(cluster["smoking_gun"], lambda m: _text("- ", m, "\n")), "\n")),
        _some(found, _text("**Trace documents:**\n\n", F.when(acted, wide).otherwise(plain))),
    )


def markdown(rubric: Column) -> Column:
    """A rubric (of schemas.INCIDENT, its time as text) as Markdown: what it is about, the mechanism, metrics by layer with onsets, logs and traces with their evidence. Frontend symptoms are not shown."""
    s = rubric["symptoms"]
    return _text(
        "# ", rubric["feature_flag"], "\n\n**Feature flag:** ", _code(rubric["feature_flag"]), "\n\n**Description:** ", rubric["description"], "\n\n**Incident time:** ", rubric["incident_time"],
        "\n\n## Mechanism\n\n", rubric["mechanism"], "\n\n", _told(rubric["interaction"], "**Interaction with other feature flags:** ", rubric["interaction"]),
        "## Evidence\n\n### Metrics\n\n", *[_layer(s["metrics"], name, said) for name, said in LAYERS.items()],
        "### Logs\n\n", _each(s["logs"], _log), "### Traces\n\n", _each(s["traces"], _trace),
    )
