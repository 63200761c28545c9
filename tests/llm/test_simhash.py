from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from quern.llm import components, queries, simhash

from .tables import AWKWARD, clashing, docs_of, least_reachable


def brute_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = least_reachable(ids, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_neardup(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_links_of_planted_balls_with_small_shards(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(20):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (v >> 63 << 64) for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for limit in (8, 4096):
        found = simhash.links(table, 3, shard_rows=limit).collect()
        brute = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
        assert least_reachable(signed, [(r.a, r.b) for r in found]) == least_reachable(signed, brute)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1200)}}


def test_awkward_rows(spark):
    docs = clashing(docs_of(spark, AWKWARD))
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.grouped(docs).collect()]
    assert len(got) == len(AWKWARD)
    by = {i: (f, c) for i, f, c in got if i is not None}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4] == by[5] and by[5][1] == 4
    for i, t in AWKWARD:
        if i is not None:
            assert by[i][0] & (2**64 - 1) == brute_fingerprint(t)
    assert simhash.grouped(docs.limit(0)).collect() == []


def test_deduplicated_keeps_one_of_each_group(spark):
    docs = docs_of(spark, [(i, t) for i, t in AWKWARD if i is not None])
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept) == [1, 4, 6, 7, 8]
    assert simhash.deduplicated(docs).columns == docs.columns
    assert simhash.deduplicated(docs.where(F.lit(False))).count() == 0
