from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import sharding

from .tables import AWKWARD, clashing, docs_of


def test_slots_sizes_and_growth(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, texts = sharding.shard(docs).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(24))


def test_many_keys_spread_by_weight_and_move_little(spark):
    keys = spark.range(40_000).select(F.col("id"))
    weights = [1.0, 2.0, 1.0]
    got = keys.select(sharding.shard_of(F.col("id"), weights).alias("a"), sharding.shard_of(F.col("id"), [*weights, 1.0]).alias("b")).collect()
    share = Counter(r.a for r in got)
    assert abs(share[1] / 40_000 - 0.5) < 0.02
    moved = [r for r in got if r.a != r.b]
    assert all(r.b == 3 for r in moved) and abs(len(moved) / 40_000 - 0.2) < 0.02


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = sharding.shard(docs_of(spark, [(k % 300, "t") for k in range(900)]), n_shards=3).collect()
    assert len(rows) == 900
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_awkward_rows(spark):
    docs = clashing(docs_of(spark, AWKWARD))
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.size for r in rows if r.doc_id == 1} == {8}
    assert sharding.shard(docs.limit(0)).collect() == []
