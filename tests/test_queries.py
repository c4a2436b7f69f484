"""Every query on the smallest tables against its SQL."""

import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for path in Path(small).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'").fetchall()
    return con


CORE = [n for n in entry.queries() if n not in (entry._llm.QUERIES if entry._llm else {})]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, tables, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in entry.oracle_sql():
        rel = tables.sql(entry.oracle_sql()[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert [rel.columns[i] for i in order] == columns
        assert got == Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
