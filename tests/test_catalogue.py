"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lattica.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_oracle(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    places = [want.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_oracle(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and len(out.collect()) > 0
