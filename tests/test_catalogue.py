"""Every query against its SQL twin, over whole small tables."""

import duckdb
import pytest
from folioscan.plans import catalogue

DATA = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    left = sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in got.collect())))
    want = duck.execute(f"select * from ({catalogue.ORACLE_SQL[name]})").to_arrow_table()
    assert sorted(want.column_names) == columns
    right = sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in want.to_pylist())))
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
