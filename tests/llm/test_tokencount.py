from __future__ import annotations

import random

from quern.llm import queries, tokencount

from .tables import AWKWARD, clashing, docs_of


def greedy(word, openers, continuers, longest):
    n, at = 0, 0
    while at < len(word):
        vocabulary = continuers if at else openers
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 0
        n, at = n + 1, at + size
    return n


def test_small_vocabularies_equal_greedy_search():
    rng = random.Random(8)
    for _ in range(60):
        openers, continuers = ({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(12))} for _ in range(2))
        own = tokencount.LongestMatch(openers, continuers)
        for _ in range(200):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 15)))
            assert own.count(word) == greedy(word, openers, continuers, 6)


def test_query_equals_greedy_search(spark, sf_dir):
    with open(tokencount.default_path()) as f:
        openers, continuers = map(set, tokencount.pieces_of(f.read()))
    longest = max(map(len, openers | continuers))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = {}
    rows = queries.op8_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = docs[r.doc_id].encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy(w, openers, continuers, longest)
        unknown = sum(known[w] == 0 for w in words)
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(known[w] for w in words) + unknown, unknown)


def test_awkward_rows(spark):
    rows = tokencount.counts(clashing(docs_of(spark, AWKWARD))).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[2].n_tokens, by[3].n_tokens, by[8].n_tokens) == (0, 0, 0, 30000)
    assert tokencount.counts(docs_of(spark, AWKWARD).limit(0)).collect() == []


def test_words_without_an_opening_piece(spark):
    """Cyrillic, Chinese and Korean words open with a plain piece, single bytes at the least."""
    with open(tokencount.default_path()) as f:
        openers, continuers = map(set, tokencount.pieces_of(f.read()))
    words = ["рассказывающий", "学" * 50, "中文文本没有空格", "한국어텍스트입니다", "\u0490x"]
    assert any(greedy(w.encode(), openers, continuers, 200) == 0 for w in words)
    want = [greedy(w.encode(), openers, continuers, 200) or greedy(w.encode(), continuers, continuers, 200) for w in words]
    rows = {r.doc_id: r for r in tokencount.counts(docs_of(spark, list(enumerate(words)))).collect()}
    assert [(rows[k].n_tokens, rows[k].n_unknown) for k in range(len(words))] == [(n, 0) for n in want]
