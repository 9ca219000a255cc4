"""Work that is dealt to tasks in proportion to the rows: pairs of blocks, keys, runs and polygons."""

import numpy as np
from pyspark.sql import functions as F

from loomgrid.operators import overlap, parents, raster, validation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(records, links):
    one = {}
    for s, p in links:
        one[s] = min(p, one.get(s, p))
    want = set()
    for i, s, ap in records:
        seen, at = set(), one.get(s)
        while at is not None and at not in seen and at != s:
            seen.add(at)
            at = one.get(at)
        want |= {(i, o) for o, t, _ in records if t in seen} | {(i, i)} | ({(i, ap)} if ap is not None else set())
    return want


def test_pairs_of_items_that_do_not_hide_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(parents, "BLOCK", 7, raising=False)
    links = [("b", "a"), ("b", "z"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "gone")]
    records = [(k, "abcdef"[k % 6], {0: None, 1: k, 2: k // 2, 3: 1000}[k % 4]) for k in range(200)]
    of = lambda r: parents.non_occluders(spark.createDataFrame(r, "item long, semantic string, assembly_parent long"), spark.createDataFrame(links, "semantic string, parent string"))
    got = of(records)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(records, links)
    assert not any("Exchange hashpartitioning(item" in x and "other" in x and "assembly" not in x for x in plan(got).splitlines()[:8])
    assert "HashAggregate(keys=[item" not in plan(got).splitlines()[1] + plan(got).splitlines()[2]
    twice = records + [(5, "c", None)]
    rows = [tuple(r) for r in of(twice).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(twice, links)


def test_keys_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(validation, "DEALT", 100)
    x = spark.range(2000).select((F.col("id") % 1990).alias("k"))
    found = validation.duplicate_keys(x, ["k"], "r")
    lost = validation.orphans(x, "k", spark.range(1980).withColumnRenamed("id", "p"), "p", "r")
    assert "hashpartitioning(k" in plan(found) and ", 20), REPARTITION" in plan(found) and ", 20), REPARTITION" in plan(lost)
    assert {(r.key, r.rows) for r in found.collect()} == {(f'{{"k":{k}}}', 2) for k in range(10)}
    assert {(r.key, r.rows) for r in lost.collect()} == {(str(k), 1) for k in range(1980, 1990)}


def test_runs_are_taken_apart_row_by_row(spark):
    rng = np.random.default_rng(3)
    masks = [rng.random(63) < p for p in (0.1, 0.5, 0.9, 1.0)] + [np.arange(63) == k for k in (0, 62)]
    rows = [(0, k, int(e)) for k, m in enumerate(masks) for e in np.flatnonzero(m)]
    runs = raster.encode_runs(spark.createDataFrame(rows, "case_id long, set_id long, e long"), 9, 7)
    for r in runs.collect():
        flat = masks[r.set_id].reshape(7, 9).T.ravel()
        assert sum(r.counts) == 63 and min(r.counts[1:], default=1) > 0
        assert (np.repeat(np.arange(len(r.counts)) % 2 == 1, r.counts) == flat).all()
    kept = spark.createDataFrame([(tuple(r)) for r in runs.collect()], "case_id long, set_id long, counts array<long>").withColumn("width", F.lit(9))
    back = raster.decode_runs(kept, "counts", F.lit(7))
    assert "Exchange" not in plan(back)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_a_polygon_of_a_set_is_drawn_once(spark):
    square = [1.0, 1.0, 3.0, 1.0, 3.0, 2.0, 1.0, 2.0]
    rows = spark.range(3000).select(F.lit(0).alias("case_id"), (F.col("id") % 3).alias("set_id"), F.array(*map(F.lit, square)).alias("polygon"))
    x = raster.decode_polygons(rows.unionByName(spark.createDataFrame([(0, 2, [0.0] * 6)], rows.schema)), 8, 8)
    assert plan(x).split("MapInPandas")[1].count("HashAggregate") >= 1
    assert sorted((r.set_id, r.e) for r in x.collect()) == sorted([(s, y * 8 + x_) for s in range(3) for y in (1, 2) for x_ in (1, 2, 3)] + [(2, 0)])


def word_sets(spark):
    """Sets of random words, small ones inside others, near and equal ones."""
    rng = np.random.default_rng(11)
    sets = [set(map(int, rng.zipf(1.3, rng.integers(1, 60)) % 300)) for _ in range(120)]
    sets += [set(s) for s in sets[:20]] + [set(sorted(s)[: max(1, len(s) // 2)]) for s in sets[20:50]] + [s | {1000 + k} for k, s in enumerate(sets[50:60])] + [{5000}, set(range(40)), set(range(40))]
    rows = [(k % 2, k, sorted(s)) for k, s in enumerate(sets)]
    return sets, overlap.with_sizes(spark.createDataFrame(rows, "case_id int, set_id long, s array<long>"))


def test_pairs_are_those_of_brute_force(spark):
    sets, x = word_sets(spark)
    inter = {(a, b): len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if a % 2 == b % 2}
    for t in (0.3, 0.82):
        want = {(a, b, i, len(sets[a]), len(sets[b])) for (a, b), i in inter.items() if i / len(sets[a] | sets[b]) >= t - 1e-12}
        got = [(r.a, r.b, r.inter, r.na, r.nb) for r in overlap.set_pairs(x, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    want = {(a, b, i) for (a, b), i in inter.items() if i >= 0.9 * min(len(sets[a]), len(sets[b])) - 1e-9}
    assert {(r.a, r.b, r.inter) for r in overlap.contained_pairs(x, 0.9).collect()} == want


def test_sets_are_not_written_and_meet_by_shared_elements(spark, monkeypatch):
    _, x = word_sets(spark)
    written = []
    put = overlap.materialize
    monkeypatch.setattr(overlap, "materialize", lambda df, label, **k: written.append((label, put(df, label, **k))) or written[-1][1])
    overlap.set_pairs(x, 0.5)
    arrays = [(n, t) for n, t in written if "s" in t.columns]
    assert [n for n, _ in arrays] == ["shared"]
    assert arrays[0][1].where("array_contains(s, 5000)").isEmpty()


def test_smallest_containers(spark, monkeypatch):
    sets, x = word_sets(spark)
    want = {}
    for a, s in enumerate(sets):
        fits = [(len(t), b) for b, t in enumerate(sets) if a % 2 == b % 2 and a != b and len(s) <= 0.72 * len(t) and len(s & t) / len(s) >= 0.9]
        if fits:
            want[a] = min(fits)[1]
    got = overlap.smallest_containers(x, 0.9, 0.72).collect()
    assert len(got) == len(want) > 30 and {r.a: r.b for r in got} == want
    assert all((r.na, r.nb, r.inter) == (len(sets[r.a]), len(sets[r.b]), len(sets[r.a] & sets[r.b])) for r in got)
