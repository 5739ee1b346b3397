"""Every query that SQL can express gives the SQL's rows."""

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, datetime):
        v = v.date()
    if isinstance(v, date):
        return str(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    v = float(v)
    return "None" if math.isnan(v) else f"{v + 0.0:.5f}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = ALL[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
