"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from heliograph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(v) for v in r) for r in df.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
