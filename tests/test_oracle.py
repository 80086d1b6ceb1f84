"""Every registered quote query against its DuckDB text on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tickloom.plans import catalog, extras, oracle, replay_oracle, stored  # noqa: F401  all add to the texts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def test_every_text_has_its_query():
    assert set(oracle.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_its_text(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in cols]) for r in df.collect()))
    rel = duck.sql(oracle.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
