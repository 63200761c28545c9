"""The registered queries of this subpackage, their SQL, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, codebooks, conversations, decontaminate, fingerprints, licenses, lm, oracles, pages, quality, sharding, simhash, suffixdedup, tokencount


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.cut(_docs(spark, sf_dir).select("doc_id", "text"), depth=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_docs(spark, sf_dir))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_docs(spark, sf_dir), bpe.default_path(), ids=False)


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(_docs(spark, sf_dir), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_docs(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(_docs(spark, sf_dir), tokencount.default_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_docs(spark, sf_dir))
    base = F.filter("detections", lambda d: d["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    word = F.transform(base, lambda d: d["start_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"),
        joined("detections").alias("labels"),
        "score",
    )


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir), n_shards=24)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.trained(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.digest() if books is not None else "")
    return codebooks.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_bpe_roundtrip": op4_bpe_roundtrip,
        "op5_simhash_neardup": op5_simhash_neardup,
        "op6_lm_scores": op6_lm_scores,
        "op7_decontamination": op7_decontamination,
        "op8_token_counts": op8_token_counts,
        "op9_license_scan": op9_license_scan,
        "op10_rendezvous_shards": op10_rendezvous_shards,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_main_texts": op12_main_texts,
        "op13_vector_codes": op13_vector_codes,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
    bi AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM bi),
    di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
    dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM di),
    hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.w = dw.w),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7_SQL, "op11_conversation_repair": oracles.op11(), "op13_vector_codes": oracles.op13()}
