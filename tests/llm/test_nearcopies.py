from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quern.llm import nearcopies

from .tables import AWKWARD, docs_of, least_reachable


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """All pairs of distinct texts that are alike in 0.8 or more of their shingles, and the ids that stay."""
    ids, sets = {}, {}
    for i, text in rows:
        ids.setdefault(text, i)
        sets.setdefault(text, shingles(text))
    names = list(sets)
    posted = {}
    for k, x in enumerate(names):
        for s in sets[x] or {b""}:
            posted.setdefault(s, []).append(k)
    pairs = {(a, b) for p in posted.values() for n, b in enumerate(p) for a in p[:n]}
    near = [(names[a], names[b]) for a, b in pairs if 5 * len(sets[names[a]] & sets[names[b]]) >= 4 * len(sets[names[a]] | sets[names[b]])]
    linked = [(ids[x], i) for i, x in rows] + [(ids[a], ids[b]) for a, b in near]
    return near, set(least_reachable([i for i, _ in rows], linked).values())


def test_stage_finds_every_pair_of_the_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near, want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert near
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()} == want


@pytest.mark.parametrize("common", [64, 2])
def test_texts_around_the_limit(spark, monkeypatch, common):
    """Chains of edited texts of all lengths, a shared passage in many; with a low limit most shingles count as common."""
    monkeypatch.setattr(nearcopies, "COMMON", common)
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    rng = random.Random(1)
    line = " ".join(f"line{k}" for k in range(30))
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 20, 60, 200, 700)))]
        if rng.random() < 0.5:
            words += line.split()
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    rng.shuffle(rows)
    near, want = brute(rows)
    assert 20 < len(near) and len(want) < len(rows)
    docs = docs_of(spark, rows)
    assert {r.doc_id for r in nearcopies.deduplicated(docs).collect()} == want


def test_awkward_rows(spark):
    docs = docs_of(spark, AWKWARD)
    kept = [r.doc_id for r in nearcopies.deduplicated(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 6, 7, 8] and kept.count(None) == 2
    assert nearcopies.deduplicated(docs.limit(0)).collect() == []


def test_simhash_links_come_first_and_are_exact(spark, monkeypatch):
    """Near copies within three bits are linked by SimHash and the exact test, and are not searched for again; other texts within three bits are not linked."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(900)]
    few = [f"v{k}" for k in range(12)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (2, " ".join(words * 2)), (3, " ".join(few)), (4, " ".join(few[::-1])), (5, "")]
    seen, near = {}, nearcopies._near
    by_simhash = nearcopies.by_simhash

    def spy_links(docs, prints):
        seen["prints"] = {(r.node, r.fp) for r in prints.collect()}
        out = by_simhash(docs, prints)
        seen["links"] = {(r.a, r.b) for r in out.collect()}
        return out

    def spy_near(found):
        out = near(found)
        seen["roots"] = {r.node: r.root for r in found.collect()}
        seen["later"] = out.count()
        return out

    monkeypatch.setattr(nearcopies, "by_simhash", spy_links)
    monkeypatch.setattr(nearcopies, "_near", spy_near)
    monkeypatch.setattr(nearcopies, "RADIUS", 3)
    kept = {r.doc_id for r in nearcopies.deduplicated(docs_of(spark, rows)).collect()}
    name = {i: nearcopies._name(nearcopies.shingle_set((t or "").encode())) for i, t in rows}
    assert kept == brute(rows)[1] == {0, 3, 4, 5}
    ends = {x for link in seen["links"] for x in link}
    assert {name[0], name[1]} <= ends <= {name[0], name[1], name[2]}
    assert seen["roots"][name[0]] == seen["roots"][name[1]] and not seen["later"]
    # One radius that takes all for near: the exact test still decides.
    monkeypatch.setattr(nearcopies, "RADIUS", 15)
    assert {r.doc_id for r in nearcopies.deduplicated(docs_of(spark, rows)).collect()} == {0, 3, 4, 5}
