from __future__ import annotations

import corpus_pipeline
from quern.llm import quality

from . import test_decontaminate, test_suffixdedup
from .tables import AWKWARD, least_reachable

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    """Five-word shingles of a text as a set; fewer words make one."""
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DIR), "test")
        outs.append(docs)
    first = rows_of(spark.read.parquet(f"{DIR}/documents.parquet"))
    good, single, cut, clean, ids = map(rows_of, outs)
    model = quality.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    order = sorted(first)
    scores = dict(zip(order, model.scores([first[i].text.encode() for i in order])))
    assert set(good) == {i for i in first if scores[i] >= quality.THRESHOLD}
    sets = {i: shingles(r.text) for i, r in good.items()}
    names = sorted(sets)
    linked = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert set(single) == set(least_reachable(names, linked).values())
    want = {i: n for i, _, n, _, _ in test_suffixdedup.brute([(i, r.text) for i, r in single.items()], 100)}
    assert set(cut) == set(single)
    for i, r in cut.items():
        lost = len(single[i].text.encode()) - len(r.text.encode())
        assert want[i] <= lost <= want[i] + 3 * 2 * want[i] and r.n_chars == len(r.text)
        assert want[i] or r.text == single[i].text
    items = [tuple(x) for x in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, *_, bad in test_decontaminate.brute([(i, r.text) for i, r in cut.items()], items) if bad}
    assert set(clean) == set(cut) - hit and hit
    assert set(ids) == set(clean)
    assert all(out.columns == corpus_pipeline.COLUMNS for out in outs[:-1])


def test_awkward_and_empty_tables_pass_through(spark, tmp_path):
    for name, rows in (("awkward", AWKWARD), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "some words that are nowhere else at all in any text here"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert sorted(r.doc_id for r in out if r.doc_id is not None) == ([1, 4, 6, 7, 8] if rows else [])
