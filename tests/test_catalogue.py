"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quern.plans import catalogue

SF = os.environ.get("QUERN_TEST_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    rows = [tuple("null" if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else str(pd.Timestamp(x)) if hasattr(x, "isoformat") else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    assert a == b


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_equal_numbers_have_places_by_their_supplier(spark, tmp_path):
    """2 with two nines behind it and 29 with one are one number: places follow the keys then, however the rows lie."""
    keys = [1, 2, 29, 3474, 34749]
    for k, order in enumerate((keys, keys[::-1])):
        spark.createDataFrame([(s, 5) for s in order], "s_suppkey long, s_nationkey int").repartition(3).write.parquet(str(tmp_path / f"{k}/supplier.parquet"))
        places = {r.s_suppkey: r.place for r in catalogue.queries()["natural_order"](spark, str(tmp_path / str(k))).collect()}
        assert places[29] == places[2] + 1 and places[34749] == places[3474] + 1 and sorted(places.values()) == [1, 2, 3, 4, 5]


def test_suppliers_without_batch_or_number_come_last(spark, tmp_path):
    rows = [(1, 5), (None, 5), (30, None), (4, 5), (None, None), (None, 5), (7, None), (2, 12), (3, 0), (None, 0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").repartition(3).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got, want = catalogue.queries()["natural_order"](spark, str(tmp_path)).collect(), con.sql(catalogue.oracle_sql()["natural_order"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def _same(spark, duck, name, folder):
    return plain(catalogue.queries()[name](spark, folder).toPandas()), plain(duck.sql(catalogue.oracle_sql()[name]).df())


def _linked(folder, *but):
    for t in TABLES:
        if t not in but:
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")


def test_calls_with_texts_in_common_keep_their_own_outputs(spark, tmp_path):
    """Unrecorded calls (every third) whose text stands in a later input, equal texts, a line of a tab, a repeated turn."""
    rows = [(1, k, "assistant", "the same thirty characters and more of them, again") for k in range(9)]
    rows += [(2, 3, "assistant", "ls"), (2, 4, "assistant", "ls -l"), (2, 5, "assistant", None), (2, 7, "assistant", "\t\nx"), (2, 8, "user", "ls"), (2, 10, "assistant", "a"), (2, 10, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("recovered_outputs", "trajectory_calls"):
        got, want = _same(spark, con, name, str(tmp_path))
        assert len(got) == (15 if name == "recovered_outputs" else 16) and got == want
