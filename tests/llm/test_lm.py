from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import lm, queries

from .tables import AWKWARD, clashing, docs_of


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return [*low.split(), None]


def base(rows):
    held = {k: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for k, (i, _) in enumerate(rows)}
    counts = Counter(t for k, (_, text) in enumerate(rows) if not held[k] for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    for k, (i, text) in enumerate(rows):
        found = tokens_of(text)
        score = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in found)
        yield i, held[k], len(found), sum(counts[t] > 0 for t in found), total, score


def agree(got, want):
    rank = lambda x: (x[0] is None, x[0] or 0, x[2], x[3])
    got, want = sorted(got, key=rank), sorted(want, key=rank)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op6_lm_scores(spark, sf_dir).collect()
    agree([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], base(docs))
    texts, same = dict(docs), {}
    for r in rows:
        assert r.score < 0 and math.isclose(r.score, same.setdefault(texts[r.doc_id], r.score), rel_tol=1e-9)
    assert all(0 < r.bits_per_byte < 60 for r in rows)


def test_held_out_scores_beat_the_base(spark):
    """With enough to learn from, by a hundredth: the base gives any unseen word the same probability, so it isn't one for text, and small corpora favour it."""
    rows = queries.op6_lm_scores(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.99 * sum(r.base_score for r in rows)


def test_awkward_rows_over_several_groups(spark):
    docs = docs_of(spark, AWKWARD)
    for size in (lm.GROUP_BYTES, 40_000):
        rows = lm.scored(clashing(docs), size).collect()
        agree([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], base(AWKWARD))
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.scored(docs.limit(0)).collect() == []


def some_model(rng, slots=1 << 12):
    code = lm.huffman(rng.integers(0, 50, (256, 256)), {ord("t") * 256 + 32: rng.integers(0, 50, 256)})
    start = lm.Start(rng.random((len(lm.ORDERS), lm.GATES)).astype(np.float32), np.sort(rng.random((lm.PLACES, lm.POINTS)).astype(np.float32), axis=1))
    return lm.Model(code, [rng.integers(-12000, 12000, slots).astype(np.int16) for _ in lm.ORDERS], start)


def test_probabilities_of_all_short_streams_sum_to_one():
    """The bits of a stream are a walk down a tree, so the probabilities of all next bytes add up."""
    model = some_model(np.random.default_rng(6))
    scores = model.scores([b"some text " + bytes([b]) for b in range(256)])
    whole = model.scores([b"some text "])[0]
    assert abs(sum(10 ** (s - whole) for s in scores) - 1) < 1e-4


WIDE = (1 << 64) - 1


def hashed(x, odd):
    x = (x + 1) * odd & WIDE
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 & WIDE) >> 32


def word_hash(word):
    """All bytes of a word: a polynomial modulo 2^64, its length added, scrambled."""
    x = (sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) + len(word)) & WIDE
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & WIDE
    return (x ^ x >> 32) >> 32


def one_by_one(model, body):
    """Bits of a stream, by a coder that looks at one bit after another and at nothing but the bytes before."""
    data = b"\n" * 6 + body
    slots, total, word, before = len(model.tables[0]), 0.0, 0, 0
    for at in range(6, len(data)):
        if (at - 6) % lm.STRETCH == 0:
            weights = [[float(x) for x in row] for row in model.start.weights]
            points = [[float(x) for x in row] for row in model.start.points]
        start = at
        while data[start - 1 : start] not in (b" ", b"\n"):
            start -= 1
        ahead = at - start
        past = lambda n, at=at: int.from_bytes(data[max(0, at - n) : at], "big")
        word = word_hash(data[start:at])
        # The word before ends at the gap before this one.
        stop, first = start - 1, start - 1
        while first > 0 and data[first - 1 : first] not in (b" ", b"\n"):
            first -= 1
        before = word_hash(data[first:stop])
        keys = [hashed(past(k), odd) for k, odd in ((2, 0xA24BAED4963EE407), (4, 0xC2B2AE3D27D4EB4F), (6, 0x9FB21C651E98DF25))]
        keys += [word, (word * 0x9E3779B1 + before * 0x85EBCA6B) & 0xFFFFFFFF]
        code = model.code
        key = 256 * int(code.which[256 * data[at - 2] + data[at - 1]]) + data[at]
        steps = [int(x) for x in code.steps[int(code.first[key]) : int(code.first[key]) + int(code.length[key])]]
        raws = [[int(t[(k % slots) ^ (s >> 1) % lm.LINE]) for t, k in zip(model.tables, keys)] for s in steps]
        gate = (ahead == 0) * 16 + (raws[0][2] & 3) * 4 + (raws[0][3] & 3)
        place, pushes, moves = min(ahead, lm.PLACES - 1), [0.0] * len(keys), []
        for s, raw in zip(steps, raws):
            bit, x = s & 1, [(r >> 2) / lm.LOGIT_SCALE for r in raw]
            mixed = sum(w[gate] * y for w, y in zip(weights, x))
            odds = 1 / (1 + math.exp(-min(20, max(-20, mixed))))
            spot = (min(lm.MAP_LIMIT, max(-lm.MAP_LIMIT, mixed)) + lm.MAP_LIMIT) * (lm.POINTS - 1) / (2 * lm.MAP_LIMIT)
            low = min(int(spot), lm.POINTS - 2)
            left, right = points[place][low], points[place][low + 1]
            told = (odds + left * (1 - spot + low) + right * (spot - low)) / 2
            total -= math.log2(told if bit else 1 - told)
            pushes = [p + lm.RATE * (bit - odds) * y for p, y in zip(pushes, x)]
            moves += [(low, lm.MAP_RATE * (bit - left) * (1 - spot + low)), (low + 1, lm.MAP_RATE * (bit - right) * (spot - low))]
        for w, p in zip(weights, pushes):
            w[gate] += p
        for k, d in moves:
            points[place][k] += d
    return total


def test_bits_equal_a_coder_that_goes_one_by_one():
    rng = np.random.default_rng(11)
    model = some_model(rng)
    words = [bytes(rng.integers(97, 110, rng.integers(1, 12), np.uint8)) for _ in range(60)]
    bodies = [lm.stream(x) for x in (b"", b"the cat the hat", "ünï cödé 漢字".encode(), b" ".join(words[k] for k in rng.integers(0, 60, 900)), b"x" * 5000)]
    assert len(bodies[3]) > 2 * lm.STRETCH
    got = model.coded(bodies)[0]
    assert np.allclose(got, [one_by_one(model, b) for b in bodies], rtol=1e-6, atol=1e-4)
    # Alone or together, a text costs the same.
    assert np.allclose(got, [model.coded([b])[0][0] for b in bodies], rtol=1e-9)


def test_learned_weights_serve_better_than_plain_ones(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    bodies = [lm.stream(t.encode()) for t in texts]
    counted, fit, rest = bodies[::3], bodies[1::3], bodies[2::3]
    code = lm.huffman(np.ones((256, 256), np.int64), {})
    model = lm.Model(code, [], lm.Start.plain())
    tables = [np.zeros(2 * lm.FIT_SLOTS, np.uint32) for _ in lm.ORDERS]
    for k, at in lm.addresses(counted, code, lm.FIT_SLOTS):
        np.add.at(tables[k], at.astype(np.int64), np.uint32(1))
    model.tables = [lm.logits(t) for t in tables]
    plain = model.coded(rest)[0].sum()
    model.start = lm.fitted(code, [x for pair in zip(counted, fit) for x in pair])
    assert model.coded(rest)[0].sum() < plain


def test_counts_equal_counting_one_by_one():
    bodies = [lm.stream(x) for x in (b"the cat the hat", b"", b"cat")]
    code = lm.huffman(np.zeros((256, 256), np.int64), {})
    slots = 1 << 14
    tables, counts = [np.zeros(2 * slots, np.uint32) for _ in lm.ORDERS], [lm.Counts() for _ in lm.ORDERS]
    for k, at in lm.addresses(bodies, code, slots):
        np.add.at(tables[k], at.astype(np.int64), np.uint32(1))
        counts[k].add(at)
    bits = 8 * sum(map(len, bodies))  # even counts make even trees
    assert [int(t.sum()) for t in tables] == [bits] * len(lm.ORDERS)
    again = np.zeros(2 * slots // lm.CHUNKS, np.uint64)
    for chunk, _, blob in lm._pack_counts(0, *counts[0].total(), 2 * slots, 0):
        again[:] = 0
        lm._unpack(blob, again)
        assert (again == tables[0][chunk * len(again) : (chunk + 1) * len(again)]).all()


def test_tables_grow_with_the_corpus(spark):
    assert [lm.slots_for(n) for n in (0, 1, 10**6, 1 << 24, (1 << 24) + 64, 1 << 30)] == [1 << 18, 1 << 18, 1 << 18, 1 << 18, 1 << 19, 1 << 24]
    rng = np.random.default_rng(7)
    rows = [(k, bytes(rng.integers(97, 105, 20_000, np.uint8)).decode()) for k in range(15)]
    trained = lm.train(docs_of(spark, rows).select("doc_id", "text"))
    model = trained.model
    assert [len(t) for t in model.tables] == [lm.LEAST_SLOTS] * len(lm.ORDERS)
    # Every bit of every text was counted, whatever the number of parts and levels.
    bodies = [lm.stream(t.encode()) for _, t in rows]
    tables = [np.zeros(2 * lm.LEAST_SLOTS, np.uint32) for _ in lm.ORDERS]
    for k, at in lm.addresses(bodies, model.code, lm.LEAST_SLOTS):
        np.add.at(tables[k], at.astype(np.int64), np.uint32(1))
    assert all((lm.logits(t) == m).all() for t, m in zip(tables, model.tables))


def test_sums_of_many_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    docs = docs_of(spark, [(k, f"text number {k} of some") for k in range(60)]).select("doc_id", "text").repartition(9)
    model = lm.train(docs).model
    tables = [np.zeros(2 * lm.LEAST_SLOTS, np.uint32) for _ in lm.ORDERS]
    for k, at in lm.addresses([lm.stream(f"text number {k} of some".encode()) for k in range(60)], model.code, lm.LEAST_SLOTS):
        np.add.at(tables[k], at.astype(np.int64), np.uint32(1))
    assert all((lm.logits(t) == m).all() for t, m in zip(tables, model.tables))


def test_sparse_counts_equal_a_table():
    rng = np.random.default_rng(8)
    slots = 1 << 14
    counts, table = lm.Counts(), np.zeros(2 * slots, np.uint32)
    counts.RAW, counts.LEAST = 500, 100
    for _ in range(40):
        at = rng.choice(np.array([*range(300), 2 * slots - 1], np.uint32), 77)
        counts.add(at)
        np.add.at(table, at.astype(np.int64), np.uint32(1))
    at, n = counts.total()
    assert (at == np.flatnonzero(table)).all() and (n == table[at]).all()


def test_the_sample_is_never_empty(spark):
    long = docs_of(spark, [(1, "first words " * 300_000), (2, "second words " * 300_000)]).select("doc_id", "text")
    for limit in (1000, 1 << 20):
        sample = lm._sample(long, 7_000_000, limit)
        assert sum(map(len, sample)) == limit
    few = docs_of(spark, [(k, f"a text {k}") for k in range(5)]).select("doc_id", "text")
    assert len(lm._sample(few, 50, 1 << 20)) == 5 and len(lm._sample(few, 1 << 40, 1 << 10)) == 1
    assert lm._sample(few.limit(0), 0) == []


def test_all_training_texts_teach_weights_and_map(spark):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join("".join(chr(c) for c in rng.integers(97, 101, 4)) for _ in range(rng.integers(50, 600)))) for k in range(60)]
    docs = docs_of(spark, rows).select("doc_id", "text")
    n_bytes = sum(len(lm.stream(t.encode())) for _, t in rows)
    trained = lm.train(docs, n_bytes // 2)
    told = {r.doc_id: (r.fit, r.g) for r in docs.select("doc_id", lm.halved().alias("fit"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)).alias("g")).collect()}
    tables = [np.zeros(2 * lm.LEAST_SLOTS, np.uint32) for _ in lm.ORDERS]
    for k, at in lm.addresses([lm.stream(t.encode()) for i, t in rows if not told[i][0]], trained.code, lm.LEAST_SLOTS):
        np.add.at(tables[k], at.astype(np.int64), np.uint32(1))
    tables, weights, points, total = [lm.logits(t) for t in tables], 0, 0, 0
    for g in range(3):
        bodies = sorted((lm.stream(t.encode()) for i, t in rows if told[i] == (True, g)), key=lambda x: (zlib.crc32(x), x))
        start, size = lm.learned(lm.Model(trained.code, tables, lm.Start.plain()), bodies), sum(map(len, bodies))
        assert size
        weights, points, total = weights + start.weights.astype(float) * size, points + start.points.astype(float) * size, total + size
    assert np.allclose(trained.start.weights, weights / total, atol=1e-5) and np.allclose(trained.start.points, points / total, atol=1e-5)


def test_counts_of_any_width_are_packed():
    for at, n in (([], []), ([0], [1]), ([3, 70_000, 4_000_000], [255, 1 << 33, 65_536]), ([0, 5, 6], [1, 2, 3])):
        table = np.zeros(1 << 22, np.uint64)
        lm._unpack(lm._body(np.array(at, np.uint32), np.array(n, np.uint64)), table)
        assert np.flatnonzero(table).tolist() == at and table[at].tolist() == n


def test_a_model_out_of_a_pickle_is_coded_with_the_quick_additions(monkeypatch):
    """An array whose type object came out of a pickle is added to by numpy's slow path, and models reach tasks by pickle."""
    kinds = []

    class Add:
        def __call__(self, *args, **more):
            return np.add(*args, **more)

        def at(self, array, places, values):
            kinds.append(array.dtype is np.dtype(array.dtype.str) and values.dtype is array.dtype)
            np.add.at(array, places, values)

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

    model, bodies = some_model(np.random.default_rng(3)), [lm.stream(b"some words and more words"), lm.stream(b"one")]
    want = model.coded(bodies)[0]
    monkeypatch.setattr(lm, "np", Numpy())
    assert (pickle.loads(pickle.dumps(model)).coded(bodies)[0] == want).all()
    assert kinds and all(kinds)


def test_large_counts_and_large_numbers_lose_nothing():
    counts = lm.Counts()
    counts.RAW, counts.LEAST = 10, 10
    some = np.repeat(np.array([3, 5, 7, (1 << 50) - 1], np.uint64), [1, 100_000, 2 * 16383, 16384])
    for _ in range(4):
        counts.add(some)
    for _ in range(2):
        at, n = counts.total()
        assert at.tolist() == [3, 5, 7, (1 << 50) - 1] and n.tolist() == [4, 400_000, 8 * 16383, 4 * 16384]
    assert [len(x) for x in lm.Counts().total()] == [0, 0]


def test_large_tables_are_looked_up_chunk_by_chunk(spark, monkeypatch):
    """A worker holds one chunk of tables over HELD_SLOTS; weights, map and scores are those of tables that are held whole."""
    rng = np.random.default_rng(12)
    rows = [(k, " ".join("".join(chr(c) for c in rng.integers(97, 103, rng.integers(1, 7))) for _ in range(rng.integers(0, 900)))) for k in range(80)] + [(80, None), (81, "a")]
    docs = docs_of(spark, rows)
    bodies = [lm.stream((t or "").encode()) for _, t in rows]
    whole, want = lm.train(docs.select("doc_id", "text"), 100_000), sorted(lm.scored(docs, 100_000).collect())
    held, plain = [], lm.Trained.model
    for size in (5_000, 1 << 20):
        # Each worker would fail if it asked for whole tables.
        monkeypatch.setattr(lm.Trained, "model", property(lambda self: 1 / 0))
        monkeypatch.setattr(lm, "HELD_SLOTS", lm.LEAST_SLOTS // 2)
        monkeypatch.setattr(lm, "LOOKED_BYTES", size)
        got = lm.train(docs.select("doc_id", "text"), 100_000)
        assert all(isinstance(x, lm.Broadcast) for x in got.chunks.values())
        assert (got.start.weights == whole.start.weights).all() and (got.start.points == whole.start.points).all()
        model = got.shared(spark).model
        lots = list(model.lots(bodies, 3_000))
        assert [x for lo, hi, _ in lots for x in range(lo, hi)] == list(range(len(bodies)))
        monkeypatch.setattr(lm, "opened", lambda shared: held.append(len(lm.zstandard.decompress(shared.value))) or shared.value)
        assert np.allclose(model.scores(bodies), plain.func(whole).scores(bodies), rtol=1e-9)
        monkeypatch.setattr(lm, "LOOKED_BYTES", 1 << 20)
        scored = sorted(lm.scored(docs, 100_000).collect())
        assert [r[:6] for r in scored] == [r[:6] for r in want]
        assert np.allclose([r.score for r in scored], [r.score for r in want], rtol=1e-9)
        monkeypatch.undo()
    assert set(held) == {2 * lm.LEAST_SLOTS // lm.CHUNKS}
