from __future__ import annotations

import zlib

import numpy as np

from quern.llm import quality, queries

from .tables import AWKWARD, clashing, docs_of

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, DIR).collect()}
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    truth = [(rows[x.doc_id], x.quality) for x in spark.read.parquet(f"{DIR}/labels.parquet").collect() if rows[x.doc_id].held_out]
    right = np.mean([r.predicted == q for r, q in truth])
    kept = np.mean([r.predicted for r, q in truth if q == 1])
    gone = np.mean([1 - r.predicted for r, q in truth if q == 0])
    assert right > 0.97 and kept > 0.99 and gone > 0.8


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def test_awkward_rows_and_missing_classes(spark):
    docs = clashing(docs_of(spark, AWKWARD))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(AWKWARD) and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(50)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(docs, one).good == b""
    sf = "/root/testdata/sf0.01"
    model = quality.fit(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.scored(docs.limit(0), model).collect() == []
    assert set(quality.accepted(docs_of(spark, AWKWARD), one).columns) == {"doc_id", "text", "lang", "source", "n_chars"}
