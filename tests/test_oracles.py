"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(catalog.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def paired(row):
    """Rows are paired by all that isn't a float first: engines differ in a float's last digits."""
    return repr([x for x in row if not isinstance(x, float)]), repr(row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_catalog_is_whole():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=paired)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=paired)
    assert sorted(names) == columns and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)
