"""Every registered query against its DuckDB statement."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    return value.isoformat() if isinstance(value, dt.datetime) else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, small_dir):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        # the smallest tables hold less than one fold
        assert rows or name == "walk_forward_eval"
        return
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in spots) for r in cursor.fetchall())


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.limit(1).count() == 1
