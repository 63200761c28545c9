from __future__ import annotations

import hashlib
import re

from quern.llm import decontaminate, queries

from .tables import AWKWARD, clashing, docs_of

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and (names := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    found |= names
        joined = ",".join(sorted(found))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op7_decontamination(spark, sf_dir).collect())
    want = sorted(brute(docs, items))
    assert got == want
    assert any(r[5] for r in want)


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op7_decontamination"]).fetchall()
    assert sorted(tuple(r) for r in queries.op7_decontamination(spark, sf_dir).collect()) == sorted(want)


ITEMS = [
    (1, "a b c d e f g h i j k l"),
    (2, "Lazy dog and"),
    (3, None),
    (4, ""),
    (5, "word word word word word word word word word word word"),
    (6, "lazy DOG, and"),
    (10, "b c d e f g h i j k"),
    (11, "ß 漢字"),
]
DOCS = [*AWKWARD, (20, "x a b c d e f g h i j k l y"), (21, "a b c d e f g h i j"), (22, "l a b c d e f g h i. J"), (23, "lazy"), (24, "lazy dog"), (25, "a b c d e f g h i x j k")]


def test_awkward_rows_and_short_items_in_one_or_many_blocks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {(i, n, h, k) for i, n, h, k, *_ in brute(DOCS, [(i, t) for i, t in ITEMS])}
    for limit in (1 << 20, 70):
        rows = decontaminate.found(clashing(docs_of(spark, DOCS)), items, block_bytes=limit).collect()
        assert len(rows) == len(DOCS)
        assert {(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r.items)) for r in rows} == want
    chained = next(r for r in rows if r.doc_id == 20).matches
    assert {(m.item_id, m.doc_word, m.item_word, m.n_words) for m in chained} == {("1", 1, 0, 12), ("10", 2, 0, 10)}


def test_blocks_write_no_texts(spark, monkeypatch):
    """Some twenty blocks: what is written between them has digests and finds alone, the result is that of one block."""
    kept = []
    plain = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, tag: kept.append(df.schema.fieldNames()) or plain(df, tag))
    items = [(k, " ".join(f"w{k * 3 + j}" for j in range(12))) for k in range(20)] + [(7, "once more w21 w22 w23 w24 w25 w26 w27 w28")]
    docs = [(k, " ".join(f"w{k * 2 + j}" for j in range(30))) for k in range(20)] * 2 + AWKWARD
    table = spark.createDataFrame(items, "item_id long, text string")
    shown = lambda rows: sorted((str(r.doc_id), r.n_words, str(r.spans), str(r.items), str(sorted(r.matches))) for r in rows)
    many = shown(decontaminate.found(docs_of(spark, docs), table, block_bytes=60).collect())
    assert len(kept) >= 20 and {tuple(x) for x in kept} == {("digest", "spans", "items", "matches")}
    assert many == shown(decontaminate.found(docs_of(spark, docs), table).collect())


def test_filter_and_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, DOCS)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    named = clashing(docs)
    both = decontaminate.decontaminated(named, items)
    assert both.columns == named.columns and {(r.n_words, r.spans, r.items, r.matches) for r in both.collect()} == {("clash",) * 4}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 7, 23, 24, 25]
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.found(docs.limit(0), items).collect() == []


def test_long_items_go_in_parts(spark):
    words = [f"w{k}" for k in range(60)]
    text = " ".join(words)
    parts = list(decontaminate.parts_of(text, 60, 10))
    assert len(parts) > 3 and {(k + j, w) for body, k in parts for j, w in enumerate(body.split())} == set(enumerate(words))
    windows = {tuple(body.split()[j : j + 10]) for body, _ in parts for j in range(len(body.split()) - 9)}
    assert windows == {tuple(words[j : j + 10]) for j in range(51)}
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = decontaminate.found(docs_of(spark, [(1, "x " + text), (2, " ".join(words[30:41])), (3, "w1 w2")]), items, block_bytes=60).collect()
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in rows} == {1: [(1, 61)], 2: [(0, 11)], 3: []}
    assert {(m.doc_word - 1 - m.item_word) for r in rows if r.doc_id == 1 for m in r.matches} == {0}


def test_a_block_holds_what_its_bound_says():
    rng = __import__("random").Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60_000))
    bench = decontaminate.Benchmark([("1", text, 0)], 10)
    bench.openers, bench.bounds  # noqa: B018
    arrays = [x for v in vars(bench).values() for x in (v if isinstance(v, tuple | list) else [v])]
    size = sum(x.nbytes for y in arrays for x in (y if isinstance(y, list) else [y]) if hasattr(x, "nbytes"))
    assert size < 3 * decontaminate.OBJECT_SHARE * len(text)
