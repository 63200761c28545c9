from __future__ import annotations

import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest

from quern.llm import conversations, oracles, queries

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_force(roles, faults, inserts=2):
    """Least (cost, audit) over all edits of all rows and up to `inserts` empty turns before each row and at the end."""
    best = None
    gaps = [g for n in range(inserts + 1) for g in itertools.product("ua", repeat=n)]
    choices = []
    for role, fault in zip(roles, faults):
        own = [("D", "", 2)]
        if fault in (conversations.OK, conversations.TRUNCATED):
            extra = 5 if fault == conversations.TRUNCATED else 0
            own += [("K", role[:1], extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        choices.append(own)
    for rows in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, filled)) > inserts:
                continue
            shown, audit, cost = "", "", 0
            for i, gap in enumerate(filled):
                shown, audit, cost = shown + "".join(gap), audit + "I" * len(gap), cost + 5 * len(gap)
                if i < len(rows):
                    edit, initial, price = rows[i]
                    if edit == "K" and not initial:
                        break
                    shown, audit, cost = shown + initial, audit + edit, cost + price
            else:
                if GOOD.fullmatch(shown) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_least_edits_equal_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(5)
        roles = [rng.choice(["user", "assistant", "system", "tool", " ", ""]) for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        (found,) = conversations.cheapest(roles, faults).values()
        assert found == by_force(roles, faults)


def test_blocks_compose():
    rng = random.Random(12)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), str(rng.random()), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(40))]
        whole, cut = conversations._Search(1000), conversations._Search(3)
        for row in rows:
            whole.add(*row)
            cut.add(*row)
        assert whole.finish() == cut.finish()


def digest_of(turns):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


AWKWARD = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hi?"),
    (1, 2, "assistant", "Hello."),
    (2, 0, None, None),
    (2, None, "user", " \n\t"),
    (3, 1, "user", "cut"),
    (3, 5, "user", "Done."),
    (3, 5, "user", "Done."),
    (4, 0, "", "no role."),
    (None, 0, "user", "no id?"),
    (None, 1, "assistant", "None."),
    (5, 0, "user", "long. " * 50000),
    (5, 1, "assistant", "long. " * 50000),
    (6, 2, "assistant", "b."),
    (6, 2, "assistant", "a."),
    (6, 1, "user", "Z "),
]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(AWKWARD, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("fault", "gone", "copy", "head", "audit", "place", "a.b")})
    rows = conversations.intact(table)
    found = conversations.audits(rows)
    by = {r.conv_id: r for r in found.collect()}
    assert set(by) == {1, 2, 3, 4, 5, 6, None}
    assert (by[1].audit, by[1].cost) == ("KKK", 0)
    assert (by[2].audit, by[2].blank, by[2].gaps) == ("DD", 2, 0)
    assert (by[3].truncated, by[3].duplicate, by[3].gaps, by[3].cost) == (1, 1, 3, 6)  # D, D, D
    assert by[3].audit == "DDD"
    assert by[4].audit == "D"
    assert by[None].audit == "KK" and by[5].audit == "KK"
    assert (by[6].audit, by[6].illegal) == ("DRK", 1)
    turns = {}
    for r in conversations.repaired(rows, found.select("conv_id", "audit")).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv_id, r in by.items():
        assert digest_of(turns.get(conv_id, [])) == r.repaired_sha256
    assert conversations.audits(conversations.damaged(table.limit(0))).collect() == []
    assert conversations.audits(conversations.damaged(table), block_rows=1).count() == 7


def test_conversation_whose_rows_are_all_dropped(spark):
    import zlib

    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = conversations.audits(conversations.damaged(spark.createDataFrame([(conv, 0, "user", "x.")], SCHEMA))).collect()
    assert tuple(row)[:8] == (conv, 0, 0, 0, 0, 0, 0, "") and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_conversation_is_searched_in_blocks(spark):
    rows = spark.range(20000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, CASE WHEN id % 11 = 0 THEN '' ELSE '.' END) AS text")
    own = conversations.intact(rows)
    (small,) = conversations.audits(own, block_rows=64).collect()
    (large,) = conversations.audits(own, block_rows=700).collect()
    assert small == large and len(small.audit) >= 20000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    path = f"{folder}/conversations.parquet"
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = queries.op11_conversation_repair(spark, folder)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({oracles.op11()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
