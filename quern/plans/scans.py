"""Telemetry retrieval: window scans, deduplication and summaries of logs and traces.

Stand-ins: `events` are log hits and spans (user: service; event_type error: error span),
`documents` are log bodies (source: service).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import timeline
from quern.plans.registry import Tables, big, query, r6
from quern.sources import sinks


@query("""
    SELECT a.event_id AS anchor_id, e.event_id, e.event_type
    FROM events a JOIN events e ON e.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE
    WHERE a.event_type = 'signup' AND e.event_type = 'error'
""")
def log_window_scan(t: Tables) -> DataFrame:
    """Errors within ten minutes around an incident, both ends included."""
    ten = F.expr("INTERVAL 10 MINUTES")
    anchors = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("anchor_id"), (F.col("ts") - ten).alias("lo"), (F.col("ts") + ten + F.expr("INTERVAL 1 MICROSECOND")).alias("hi"))
    errors = t.events.where("event_type = 'error'").select("event_id", "event_type", "ts")
    return timeline.within(errors, anchors, "ts", "lo", "hi", 1200).select("anchor_id", "event_id", "event_type")


@query("""
    SELECT doc_id, source, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def log_dedup_first(t: Tables) -> DataFrame:
    """The first log of each body. Bodies meet as digests, 32 bytes each, combined before the shuffle, so that neither the corpus nor a hot body travels."""
    body = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return t.documents.groupBy(body.alias("body")).agg(F.min_by(F.struct("doc_id", "source", "n_chars"), "doc_id").alias("first")).select("first.*")


@query("""
    SELECT source AS service, count(*) AS n_logs, count(DISTINCT text) AS n_unique FROM documents GROUP BY source
""")
def log_service_summary(t: Tables) -> DataFrame:
    """Logs and distinct bodies per service, the busiest first. Bodies are told by their digests."""
    rows = t.documents.select(F.col("source").alias("service"), F.unhex(F.sha2("text", 256)).alias("body"))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n_logs"), F.count_distinct("body").alias("n_unique")).orderBy(F.desc("n_logs"), "service")


@query("""
    SELECT user_id AS service, event_type AS operation, array_to_string(list_sort(list(DISTINCT props)), ';') AS events, count(DISTINCT props) AS n_events
    FROM events WHERE event_type = 'error' AND props <> '{"k": 0}' GROUP BY ALL
""")
def error_ops_distinct(t: Tables) -> DataFrame:
    """Distinct operations with the list of their distinct events, noise left out."""
    rows = t.events.where((F.col("event_type") == "error") & ~F.col("props").isin('{"k": 0}'))
    told = rows.groupBy(F.col("user_id").alias("service"), F.col("event_type").alias("operation")).agg(F.array_sort(F.collect_set("props")).alias("events"))
    return told.select("service", "operation", F.array_join("events", ";").alias("events"), big(F.size("events")).alias("n_events"))


@query("""
    SELECT user_id, event_id, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 100
""")
def first_n_per_service(t: Tables) -> DataFrame:
    return timeline.first_of(t.events.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 100).select("user_id", "event_id", "ts")


@query("SELECT DISTINCT source AS service FROM documents")
def service_list(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("service")).distinct()


@query("""
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events
    WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def json_attr_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("""
    SELECT page_id, length(html) AS n_chars, coalesce(nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), ''), 'none') AS title,
      regexp_extract(url, '^https?://([^/]+)', 1) AS host
    FROM pages
""")
def page_titles(t: Tables) -> DataFrame:
    """Fields read out of whole raw documents by patterns."""
    return t.pages.select(
        "page_id",
        big(F.char_length("html")).alias("n_chars"),
        F.coalesce(F.nullif(F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1), F.lit("")), F.lit("none")).alias("title"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


@query("""
    SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'none') AS slug,
      substr(sha256(p_name), 1, 16) AS task_name FROM part
""")
def task_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.short_digest(F.col("p_name")).alias("task_name"))


@query("""
    SELECT o_custkey, o_orderkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) d ON d.c_custkey = o_custkey
""")
def skip_done(t: Tables) -> DataFrame:
    """Work that isn't in the set of what is done."""
    done = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.todo(t.orders.select("o_custkey", "o_orderkey"), done, ["o_custkey"])


@query("""
    SELECT source AS service, lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, min(doc_id) AS first_doc
    FROM documents WHERE lower(coalesce(text, '')) LIKE '%the%' AND n_chars BETWEEN 100 AND 5000 GROUP BY ALL
""")
def filtered_log_stats(t: Tables) -> DataFrame:
    """Case-insensitive substring and range filters, then a summary."""
    rows = t.documents.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("the")) & F.col("n_chars").between(100, 5000))
    return rows.groupBy(F.col("source").alias("service"), "lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars"), F.min("doc_id").alias("first_doc"))


@query("""
    SELECT c_custkey, regexp_matches(c_name, '0[0-4]$') AS picked, contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto') AS wanted FROM customer
""")
def name_filters(t: Tables) -> DataFrame:
    """Ids by a pattern, groups by any of some substrings whatever their case."""
    return t.customer.select("c_custkey", F.col("c_name").rlike("0[0-4]$").alias("picked"), text.contains_any(F.col("c_mktsegment"), ["Build", "AUTO"]).alias("wanted"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def largest_documents(t: Tables) -> DataFrame:
    """The 25 largest documents (a top-k report)."""
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
