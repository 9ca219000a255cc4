"""Kernels on the masks of many sets at a time, and plans that don't shuffle or broadcast pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import partition, raster
from loomgrid.plans import rasters, selections, shapes  # noqa: F401
from loomgrid.plans.catalog import QUERIES
from loomgrid.plans.drawings import drawn


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("images"))
    rows = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"))
    rows.write.parquet(f"{at}/orders.parquet")
    return at


def test_pixels_are_drawn_after_the_shuffle(spark, orders):
    x = drawn(spark, orders).groupBy("case_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    assert x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["adjacency", "boundary_scores", "contrast_palette", "envelope_shares", "merged_regions", "occluder_ranks", "soft_membership", "tidy_sets"])
def test_pixels_are_not_broadcast(spark, orders, name):
    assert "BroadcastExchange" not in QUERIES[name](spark, orders)._jdf.queryExecution().executedPlan().toString()


def test_labels_of_many_masks():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m = rng.random((3, 7, 9)) < 0.5
        for eight in (True, False):
            got = raster.label_masks(m, eight)
            for mask, lab in zip(m, got):
                assert ((lab > 0) == mask).all()
                want, n = np.zeros_like(lab), 0
                for y, x in np.argwhere(mask):
                    if not want[y, x]:
                        n, open_ = n + 1, [(y, x)]
                        while open_:
                            a, b = open_.pop()
                            if 0 <= a < 7 and 0 <= b < 9 and mask[a, b] and not want[a, b]:
                                want[a, b] = n
                                open_ += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
                assert (lab == want).all()


def test_floods_of_whole_sets_are_those_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(c, 1, int(e), float(rng.integers(1, 5)), int(rng.integers(1, 4)) if rng.random() < 0.1 else None) for c in range(3) for e in np.flatnonzero(rng.random(80) < 0.8)]
    px = spark.createDataFrame(rows, "case_id long, set_id long, e long, distance double, marker int")
    whole = sorted(map(tuple, partition.flood(px, 10).select("case_id", "e", "marker").collect()))
    monkeypatch.setattr(partition, "FLOOD_WHOLE", 0)
    assert sorted(map(tuple, partition.flood(px, 10).select("case_id", "e", "marker").collect())) == whole
