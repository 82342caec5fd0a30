"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from tessera.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: "null" if v is None else f"{float(v):.6f}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    found = duck.sql(ORACLES[name])
    assert got == plain(found.columns, found.fetchall())


def test_all_but_the_session_chain_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"session_chain"}


def test_contract():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
