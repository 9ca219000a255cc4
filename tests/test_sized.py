"""Queries against their SQL on tables that are large enough for several cases."""

import glob
import os

import duckdb
import pytest

from loomgrid.plans import catalog, hypotheses, measures, rasters, selections, shapes  # noqa: F401  (register their queries)
from loomgrid.plans import hypotheses as hy

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def agrees(spark, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, DATA)
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    r = c.execute(catalog.ORACLES[name])
    at = [[x[0] for x in r.description].index(k) for k in df.columns]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == want


def test_suppliers_meet_across_cases(spark):
    p = hy.pairs(spark, DATA, whole=True)
    assert p.where(f"a div {hy.CASE} <> b div {hy.CASE}").count() > p.where(f"a div {hy.CASE} = b div {hy.CASE}").count() > 0
    got = catalog.QUERIES["affinity"](spark, DATA)
    assert not got.where(f"a div {hy.CASE} <> b div {hy.CASE}").isEmpty()


@pytest.mark.parametrize("name", ["affinity", "physical_groups", "balanced_candidates"])
def test_whole_cases_agree(spark, name):
    agrees(spark, name)


def test_namespaces_number_all_roots_of_a_name(spark):
    agrees(spark, "namespaces")


def test_pairs_are_not_shuffled_one_by_one(spark):
    from loomgrid.operators import overlap

    e = spark.range(300).selectExpr("0L AS case_id", "id % 20 AS set_id", "id % 7 AS e")
    got = overlap.overlap_pairs(e)
    shuffled = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(case_id" in x]
    assert not any("REPARTITION" not in x and "a#" in x and "b#" in x for x in shuffled)
    sets = {}
    for r in e.collect():
        sets.setdefault(r.set_id, set()).add(r.e)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r.a, r.b): r.inter for r in got.collect()} == want


def test_supports_of_a_hot_key_meet_as_one_row(spark):
    from pyspark.sql import functions as F

    from loomgrid.operators import roots

    n = spark.range(4000)
    parts = n.select(F.lit(0).alias("case_id"), F.col("id").alias("part"), F.lit("k/visual-region:1").alias("key"), F.lit(1).alias("asset"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("root"))
    supports = n.select(F.lit(0).alias("case_id"), F.lit("k").alias("key"), F.lit(1).alias("asset"), (F.col("id") % 3).alias("root"), (F.col("id") % 100).cast("double").alias("support"), F.col("id").alias("part"))
    got = {r.part: r.parent for r in roots.root_parent(parts, supports).collect()}
    best = lambda ok: min((-(k % 100), k) for k in range(4000) if ok(k % 3))[1]
    assert got == {p: best(lambda r: p % 2 or r == p % 3) for p in range(4000)}


def test_supplied_elements_are_dealt_once(spark):
    x = catalog.supplied(spark, DATA).groupBy("case_id", "e").count()
    assert x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
