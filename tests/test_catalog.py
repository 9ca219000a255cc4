"""Every catalogued query against its DuckDB SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from loomgrid.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return float(round(v, 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert df.columns
        return
    r = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
