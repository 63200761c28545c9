"""Corpus pipeline over `documents`: five stages of quern.llm, four of them operators that are also queries.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as a Parquet
table in the folder all executors share and hands it to the next. All stages but the last
return the columns of `documents`. Every stage works on all rows its predecessor kept:

1. quality: documents scoring under the classifier's threshold go.
2. near-duplicates: of documents alike in 0.8 or more of their five-word shingles (Jaccard), directly
   or by way of others, one stays, the one with the smallest id. All such pairs are found; SimHash
   prints of 64 bits differ in up to eleven bits there, too many to search for (README).
3. repeated passages: bytes in strings of passage_bytes that an earlier document has go.
4. decontamination: documents that hold a benchmark window go.
5. encoding: token ids and the text they decode to.

Rows with null texts stay until a stage's rule removes them (their text is empty from stage 3
on); an empty table passes through all stages. Repeated rows (equal id and text) are kept or
removed together, rows of equal id don't cut passages from each other. Columns besides those of
`documents`, whatever their names, are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, nearcopies, quality, suffixdedup
from quern.llm.common import written

#: A passage of over 50 words has at least 101 bytes; shorter strings (a licence line, say) stay.
PASSAGE_BYTES = 100

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    return suffixdedup.deduplicated(docs.select(*COLUMNS), depth=passage_bytes)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.default_path())


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The stages are beyond SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        more = {"passage_bytes": passage_bytes} if stage is cut_repeats else {}
        docs = written(stage(spark, docs, sf_dir, **more), name)
    return docs
