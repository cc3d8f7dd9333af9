"""Every registered query of the core against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from triplewright.plans import registry
from triplewright.plans.views import BASE


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_equals_sql(spark, sf_dir, connection, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        return
    found = connection.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
