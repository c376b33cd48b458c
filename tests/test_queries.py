"""Every query with SQL against DuckDB, on the smallest tables; the entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(repr([None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, str, bool, type(None))) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = duck.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert plain([tuple(r) for r in df.select(*names).collect()]) == plain(sql.select(*(f'"{c}"' for c in names)).fetchall())


@pytest.mark.parametrize("form", ["array", "object"])
def test_groups_hold_the_whole_table(spark, form):
    rows = entry.queries()[f"group_{form}_all"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/orders.parquet").count() > 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
