"""Every named query of the telemetry engine against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from tidewire.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.4f}".replace("-0.0000", "0.0000")
        return str(v)

    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    twin = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert comparable(df.select(*twin.columns).collect()) == comparable(twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_twin_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_the_entry_names_every_query():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
