from __future__ import annotations

import hashlib
import random

import numpy as np

from quern.llm import queries, suffixdedup

from .tables import AWKWARD, clashing, docs_of


def brute(rows, depth=50):
    """(id, bytes, removed, spans, digest of what is left) by a table of all windows."""
    first = {}
    keyed = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for o, b in keyed:
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            first[w] = min(first.get(w, o), o)
    for (i, _), (o, b) in zip(rows, keyed):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - depth + 1):
            if first[b[k : k + depth]] < o:
                gone[k + 1 : k + 1 + depth] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        yield i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op2_suffix_dedup(spark, sf_dir).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def planted():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["xy" * 60, "z" * 200]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.randrange(20)
            parts.insert(rng.randrange(4), p[a : a + rng.randrange(40, 130)])
        rows.append((i // 2 if i < 20 else i, "".join(parts)))
    return rows + [(500 + k, rows[k * 7][1]) for k in range(12)] + AWKWARD


def test_planted_over_many_groups_and_depths(spark, monkeypatch):
    rows = planted()
    docs = clashing(docs_of(spark, rows))
    for depth, size, hot in ((50, 3000, 32), (50, 3000, 2), (20, 1 << 20, 32), (100, 5000, 1)):
        monkeypatch.setattr(suffixdedup, "SORT_WINDOWS", 300 if hot < 32 else 1 << 18)
        found = suffixdedup.cut(docs, depth, size, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, found), key=key) == sorted(brute(rows, depth), key=key)


def test_long_documents_go_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE_BYTES", 200)
    data = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 10, 1500, 1500, 3000])
    h, row, first, n, place = suffixdedup.anchors(data, offsets, 50)
    assert ((place >= first + n - 1) & (place < first + 50)).all()
    windows = sorted(int(f) + j for f, k in zip(first, n) for j in range(k))
    assert windows == [*range(10, 1451), *range(1500, 2951)]
    assert set(row.tolist()) == {1, 3}


def test_radix_passes_find_equal_windows():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabc-abcabcabcabcabcabcabc", np.uint8)
    starts = np.arange(len(data) - 20 + 1)
    window, group = suffixdedup.repeated_windows(data, starts, 20)
    got = {frozenset(x.tolist()) for x in np.split(window, group[1:])}
    by = {}
    for s in starts.tolist():
        by.setdefault(data[s : s + 20].tobytes(), set()).add(s)
    assert got == {frozenset(v) for v in by.values() if len(v) > 1}


def test_deduplicated_text_and_empty_tables(spark):
    passage = "é" * 60
    docs = docs_of(spark, [(1, "x" + passage), (2, "a" + passage + "b"), (3, None)])
    rows = {r.doc_id: r for r in suffixdedup.deduplicated(docs.withColumn("n_chars", docs.doc_id)).collect()}
    assert {i: r.text for i, r in rows.items()} == {1: "x" + passage, 2: "ab", 3: ""}
    assert {i: r.n_chars for i, r in rows.items()} == {1: 61, 2: 2, 3: 0}
    assert suffixdedup.deduplicated(docs).columns == docs.columns
    named = clashing(docs)
    kept = suffixdedup.deduplicated(named)
    assert kept.columns == named.columns and {(r.doc_id, r.g, r.tag, r.n_bytes, r.kept_text) for r in kept.collect()} == {(i, *["clash"] * 4) for i in (1, 2, 3)}


def test_a_text_that_most_documents_share(spark):
    rows = [(k, "") for k in range(300)] + [(1000 + k, "the same text again and again, longer than one window of bytes") for k in range(300)]
    found = {r.doc_id: r.n_removed for r in suffixdedup.cut(docs_of(spark, rows), 50, 2000).collect()}
    assert found == {k: 0 for k in range(300)} | {1000: 0} | {1000 + k: 62 for k in range(1, 300)}


def test_an_empty_table_gives_no_rows(spark):
    docs = docs_of(spark, [(1, "x")])
    assert suffixdedup.cut(docs.limit(0)).collect() == []


def test_buckets_sorted_in_parts_answer_alike(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    texts = ["".join(rng.choice("abcd ") for _ in range(60)) + passage[k : k + 200] for k in range(0, 200, 20)]
    known, answers = suffixdedup._table([], suffixdedup._KNOWN), []
    docs = pa.table({"doc_id": list(range(len(texts))), "text": texts, "__tag": [0] * len(texts), "__g": [0] * len(texts)})
    h = suffixdedup.Group(docs, known, 50).repeated()[0]
    for kind in (1, 3):
        wanted = suffixdedup._table([(0, kind, None, None, h.tobytes(), None, None)], suffixdedup._KNOWN)
        sent = suffixdedup._send_spans(docs, wanted, 50, 1)
        for size in (1 << 18, 40):
            monkeypatch.setattr(suffixdedup, "SORT_WINDOWS", size)
            answers.append(suffixdedup._sort_spans(sent, 50))
        assert answers[-1].num_rows and answers[-1].equals(answers[-2])
