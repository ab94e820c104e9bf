"""Every ledger query against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from coinbrook import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal) or (isinstance(v, int) and not isinstance(v, bool)):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(queries.SQL[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    want = [tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert ordered(got) == ordered(want)
