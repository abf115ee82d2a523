"""Every query with SQL against DuckDB on the smallest tables, and the library without the llm subpackage."""

import math
import os

import pytest

from strata.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    done = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in done.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert got == want
