"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from codeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        order = [x[0] for x in r.description]
        assert sorted(order) == columns
        assert got == sorted(repr(tuple(plain(x[order.index(c)]) for c in columns)) for x in r.fetchall())
