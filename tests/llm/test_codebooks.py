from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest

from quern.llm import codebooks, oracles, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_force(rows, parts, entries, rounds, scale):
    """Plain Lloyd over all parts in Python integers: {row: (code, error)} and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == length]
    limit = int((2**62 / length) ** 0.5) // 2
    whole = [[max(-limit, min(limit, int(np.floor(np.float64(np.float32(x)) * scale)))) for x in v] + [0] * (-length % parts) for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p]), []).append(c[p])
            for e, own in groups.items():
                books[p][e] = tuple(sum(col) // len(own) for col in zip(*own))
    found = []
    for (vec_id, _, label), c in zip(rows, cut):
        codes = [nearest(c[p], books[p]) for p in range(parts)]
        found.append((vec_id, label, "".join(f"{k:02x}" for k in codes), sum(far(c[p], books[p][k]) for p, k in enumerate(codes))))
    return found, books


@pytest.mark.parametrize("seed,parts,entries,rounds,length", [(1, 8, 16, 6, 16), (2, 8, 16, 6, 13), (3, 2, 3, 9, 4), (4, 4, 5, 1, 4), (5, 8, 1, 3, 8), (6, 3, 4, 0, 6)])
def test_equals_plain_lloyd(spark, seed, parts, entries, rounds, length, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK_VALUES", 40 * length)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(6)]
    rows = [(i, [float(np.float32(round(x + rng.gauss(0, 0.3), 2))) for x in rng.choice(centres)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += rows[:20] + [(None, rows[5][1], 7), (400, [0.0] * length, 1), (401, [3.0e38] * length, 1)]
    coded, books = codebooks.trained(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, plain = by_force(rows, parts, entries, rounds, codebooks.SCALE)
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, coded.collect())) == order(want)
    assert books.entries.tolist() == [[list(e) for e in book] for book in plain]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [nan] * 8, 1), (2, [inf] + [0.0] * 7, 1), (3, [None] + [0.0] * 7, 1), (4, [], 1), (5, [0.5] * 8, None), (6, [0.25] * 8, None), (7, [1.0] * 9, 2), (6, [0.25] * 8, 3)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(2).withColumns({c: F.lit("clash") for c in ("vector", "code", "error", "n", "ids", "of_label", "a.b")})
    coded, _ = codebooks.trained(table)
    found = codebooks.with_label_errors(coded).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == [(5, "00" * 8, 0, 0), (6, "01" * 8, 0, 0), (6, "01" * 8, 0, 0)]
    coded, books = codebooks.trained(table.limit(0))
    assert codebooks.with_label_errors(coded).collect() == [] and books is None


def test_later_rounds_look_at_few_parts():
    """Two far groups settle at once; after that nothing but what lies between entries is scanned again."""
    rng = np.random.default_rng(13)
    values = codebooks.whole_numbers(np.concatenate([rng.normal(0, 0.01, (500, 8)), rng.normal(5, 0.01, (500, 8))]), 2, 4096)
    books = codebooks.Codebooks.of(values[[0, 600]], 2)
    block = codebooks.Block.fresh(values, 2, 2)
    scanned = []
    plain = block._rescan
    block._rescan = lambda p, places, *more: (scanned.append(len(places)), plain(p, places, *more))
    for _ in range(5):
        books = books.moved(block.advance(books))
    assert scanned == [1000, 1000]


def test_blocks_survive_packing():
    rng = np.random.default_rng(1)
    for spread in (1, 100, 10**7):
        values = codebooks.whole_numbers(rng.normal(0, spread, (50, 16)), 8, 4096)
        books = codebooks.Codebooks.of(values[:16], 8)
        block = codebooks.Block.fresh(values, 8, 16)
        books = books.moved(block.advance(books))
        again = codebooks.Block.unpacked(50, *block.packed(), books.entries.shape)
        assert (again.advance(books) == block.advance(books)).all() and (again.codes == block.codes).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = queries.op13_vector_codes(spark, f"/root/testdata/{sf}")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({oracles.op13()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
