"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run."""

import datetime
import decimal
import math
import os

import pytest

from corpuslab.plans.registry import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.5g}"
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    rel = duck.sql(ORACLE[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted(tuple(normal(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rel.fetchall())
    assert rows == want
