"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from riskframe.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        return "nan" if math.isnan(number) else number
    return str(value)


def order(row):
    """Floats compare within a tolerance, so they only sort by their leading digits."""
    return [str(round(v, 4)) if isinstance(v, float) else str(v) for v in row]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=order)
    cursor = duck.execute(SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    wanted = sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=order)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-6, nan_ok=True) if all(
            isinstance(v, float) for v in a
        ) else all(
            (x == pytest.approx(y, rel=1e-6, abs=2e-6)) if isinstance(x, float) and isinstance(y, float) else x == y
            for x, y in zip(a, b)
        ), (a, b)


def test_entry_is_the_test_split(spark):
    df = entry.entry(spark)
    assert df.select("split").distinct().collect()[0][0] == "test"
    assert len(df.columns) == 56
