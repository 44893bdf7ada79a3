"""Every query against its SQL twin on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.operators import modeling
from barloom.plans import catalogue, evaluations
from tests.conftest import TABLES

QUERIES, ORACLE = catalogue(), {name: q.oracle() for name, q in catalogue().items() if q.sql is not None}
# here the fits are run for their plumbing, with few rounds
FEW = modeling.Boosting(rounds=2)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir, monkeypatch):
    monkeypatch.setattr(evaluations, "TRAIN", FEW)
    monkeypatch.setattr(evaluations, "WALK", FEW)
    df = QUERIES[name].run(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    spark.catalog.clearCache()
    if name not in ORACLE:
        assert rows
        return
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == want


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
