from __future__ import annotations

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, queries

from .tables import AWKWARD, clashing, docs_of


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decoded(own.coded(text)).decode() == own.decode(want) == library.decode(want, skip_special_tokens=False)


ODD = ["a" * 5000, "ab" * 3000, "I'Ll we've 's'squad ''s", "<|endoftext|>x <|startoftext|><|endoftext|", "é é İSTANBUL ΣΑΣ ΟΔΟΣ", "a\x1cb\x85c\xa0d e　f", "", "  ", "\x00\x01", "12345 x1y2", "😀👍🏽", "ﬁ K Å ̈̈́", "<|ENDOFTEXT|>", "́a ̈"]


def test_odd_texts(own, library):
    for text in ODD:
        same(own, library, text)


def test_random_texts(own, library):
    rng = random.Random(4)
    pool = "aabcdeéèñüß'’.,!?-_#$%&* \t\n0123456789ABCΣİ漢字日本한국어क्षع😀́‍\x85 "
    for _ in range(1500):
        same(own, library, "".join(rng.choice(pool) for _ in range(rng.randrange(40))))


def test_every_code_point(own, library):
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for k in range(0, len(chars), 2000):
        block = [f"a{c}B{c}{c} !{c}1{c}{c}!" for c in chars[k : k + 2000]]
        for text, found in zip(block, library.encode_batch(block, add_special_tokens=False)):
            assert own.encode(text) == found.ids, ascii(text)


def test_segment_tree_yields_the_leftmost_lowest():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9):
        ranks = [rng.randrange(4) for _ in range(n)]
        tree = bpe.SegmentTree(list(ranks))
        for _ in range(30):
            live = [r for r in ranks if r is not None]
            assert tree.top() == ((min(live), ranks.index(min(live))) if live else None)
            k = rng.randrange(n)
            ranks[k] = rng.choice([0, 1, 2, 3, None])
            tree.put(k, ranks[k])


def test_segment_tree_of_more_than_2_to_the_24_places():
    ranks = [None] * (1 << 24) + [None, None, None, 5]
    tree = bpe.SegmentTree(ranks)
    assert tree.top() == (5, (1 << 24) + 3)
    tree.put((1 << 24) + 1, 5)
    assert tree.top() == (5, (1 << 24) + 1)


def test_query_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_bpe_roundtrip(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_awkward_rows(spark, library):
    rows = bpe.encoded(clashing(docs_of(spark, AWKWARD))).collect()
    assert len(rows) == len(AWKWARD)
    texts = dict(AWKWARD)
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.encoded(docs_of(spark, AWKWARD).limit(0)).collect() == []


def test_pieces_met_before_need_no_call_and_updates_end_where_nothing_changes():
    c = bpe.Codec(open(bpe.default_path(), encoding="utf-8").read())
    ids = c.coded("an unusualpiece")
    c._missed = None
    assert c.coded("an unusualpiece") == ids and c.young["an"] == ids[: len(c.young["an"])]
    rng = random.Random(7)
    ranks = [rng.choice([None, *range(5)]) for _ in range(21)]
    tree = bpe.SegmentTree(ranks)
    for _ in range(300):
        place, ranks_now = rng.randrange(21), rng.choice([None, *range(5)])
        ranks[place] = ranks_now
        tree.put(place, ranks_now)
        assert tree.top() == min(((r, k) for k, r in enumerate(ranks) if r is not None), default=None)
