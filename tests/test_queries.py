"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry
from tessera.session import TABLES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, sf_dir, oracle):
    df = registry.queries()[name](spark, sf_dir)
    expected = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(value(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(value(r[names.index(c)]) for c in order) for r in expected.fetchall())
    assert got == want
