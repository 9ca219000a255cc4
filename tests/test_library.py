"""Library operators on small fixtures: edge cases, ties and order."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.functions import scores, text, vectors
from loomgrid.operators import assignment, evaluation, graph, ordered, overlap, ownership, parents, priors, raster, regions, retrieval, routing, stats, suppression, validation
from loomgrid.sources import readers, writers
from loomgrid.streaming import windows


def box(case, set_id, x0, y0, x1, y1, width=64):
    return [(case, set_id, y * width + x) for y in range(y0, y1) for x in range(x0, x1)]


def elems(spark, rows):
    return spark.createDataFrame(rows, "case_id string, set_id long, e long")


def test_overlap_of_nested_identical_and_disjoint_sets(spark):
    e = elems(spark, box("c", 1, 0, 0, 4, 4) + box("c", 2, 0, 0, 4, 4) + box("c", 3, 0, 0, 2, 4) + box("c", 4, 20, 20, 22, 22) + box("d", 5, 0, 0, 4, 4))
    got = {(r.a, r.b): (r.iou, r.containment, r.area_coherence) for r in overlap.overlap_pairs(e).collect()}
    assert got == {(1, 2): (1.0, 1.0, 1.0), (1, 3): (0.5, 1.0, 0.5), (2, 3): (0.5, 1.0, 0.5)}
    assert {(r.a, r.b) for r in overlap.overlap_pairs(e, 0.5).collect()} == set(got)
    assert {(r.a, r.b) for r in overlap.overlap_pairs(e, 0.51).collect()} == {(1, 2)}


def test_threshold_join_finds_all_pairs(spark):
    rng = np.random.default_rng(3)
    sets = {k: set(rng.choice(60, rng.integers(1, 30), replace=False).tolist()) for k in range(60)}
    for k in range(0, 60, 3):
        sets[k + 1] = set(list(sets[k])[: max(1, len(sets[k]) - 2)])
    e = elems(spark, [("c", k, x) for k, s in sets.items() for x in s])
    for t in (0.3, 0.82):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in overlap.overlap_pairs(e, t).collect()} == want


def test_box_pairs_count_once_across_cells(spark):
    b = spark.createDataFrame([("c", 1, 0.0, 0.0, 10.0, 10.0), ("c", 2, 5.0, 5.0, 15.0, 15.0), ("c", 3, 10.0, 0.0, 12.0, 2.0)], "case_id string, box_id long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.a, r.b, round(r.iou, 4)) for r in overlap.box_pairs(b, 3.0, 3.0).collect()] == [(1, 2, round(25 / 175, 4))]


def test_agreement_and_hierarchy(spark):
    e = elems(spark, box("c", 1, 0, 0, 4, 4) + box("c", 2, 0, 0, 4, 4) + box("c", 3, 30, 30, 34, 34))
    p = overlap.overlap_pairs(e)
    c = spark.createDataFrame([("c", 1, "wheel", "f1"), ("c", 2, "wheel", "f2"), ("c", 3, "wheel", "f3")], "case_id string, set_id long, semantic string, family string")
    assert {r.set_id: r.agreement for r in overlap.agreement(c, p).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    h = spark.createDataFrame([("c", 1, "car", None, "r", 0.8), ("c", 2, "body", "car", "r", 0.75), ("c", 3, "x", None, "r", 0.1)], "case_id string, set_id long, name string, parent string, root string, score double")
    assert sorted(r.set_id for r in overlap.hierarchy_duplicates(h, p).collect()) == [2, 3]
    assert overlap.hierarchy_duplicates(h.withColumn("root", F.lit(None).cast("string")), p).count() == 3


def test_greedy_suppression_follows_order_not_components(spark):
    items = spark.createDataFrame([(k, k) for k in range(7)], "item long, place long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (4, 3), (5, 5)], "a long, b long")
    got = {r.item: r.kept for r in suppression.greedy_suppression(items, edges).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_greedy_suppression_leaves_no_item_open(spark):
    items = spark.createDataFrame([(k, k) for k in range(8)], "item long, place long")
    chain = spark.createDataFrame([(k, k + 1) for k in range(7)], "a long, b long")
    assert {r.item: r.kept for r in suppression.greedy_suppression(items, chain, None).collect()} == {k: k % 2 == 0 for k in range(8)}
    with pytest.raises(RuntimeError, match="2 rounds"):
        suppression.greedy_suppression(items, chain, 2)


def test_caps_quotas_and_turns(spark):
    g = spark.createDataFrame([("s", k, 2 if k == 1 else 0, float(k)) for k in range(4)] + [("t", 9, 0, 1.0)], "scope string, id long, cap long, score double")
    assert sorted(r.id for r in suppression.instance_cap(g, ["scope"], "cap", [F.desc("score")]).collect()) == [2, 3, 9]
    assert [r.id for r in suppression.quota(g, ["scope"], [F.desc("score")], 1).orderBy("id").collect()] == [3, 9]
    x = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("b", 3, 1.0)], "g string, id long, score double").withColumn("s", F.lit(0))
    assert sorted(r.id for r in suppression.round_robin(x, ["s"], ["g"], [F.desc("score")], 2).collect()) == [1, 3]
    i = spark.createDataFrame([(1, 0.9, "x", "p"), (2, 0.88, "y", "p"), (3, 0.2, "z", "p")], "item long, score double, name string, parent string")
    e = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [r.item for r in suppression.ambiguous_duplicates(i, e).collect()] == [3]
    i = spark.createDataFrame([(1, 0.5, "wheel", "car"), (2, 0.88, "tyre", "wheel"), (3, 0.87, "rim", "wheel")], "item long, score double, name string, parent string")
    e = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    kept = suppression.ambiguous_duplicates(i, e).collect()
    assert [(r.item, r.collapsed) for r in kept] == [(1, ["rim", "tyre"])]


def test_graph(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "a long, b long")
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == {**{k: 0 for k in range(21)}, 50: 50, 51: 50}
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert {r.node: r.depth for r in graph.depths(t).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        graph.descendants(loop)
    assert graph.descendants(loop, on_cycle="stop").count() == 2


def test_evidence_and_ownership(spark):
    e = spark.createDataFrame([(1, "f", 0.5), (1, "f", 0.4), (1, "g", 0.5), (2, "f", 0.0)], "k long, f string, p double")
    assert {r.k: round(r.probability, 9) for r in ownership.noisy_or(e, ["k"], "f", "p").collect()} == {1: 0.75, 2: 0.0}
    s = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 9, 0.1)], "e long, c long, s double")
    assert {r.e: r.owner for r in ownership.argmax_owner(s, ["e"], "c", "s").collect()} == {1: 3, 2: 9}
    root = spark.createDataFrame([("c", y * 64 + x) for y in range(2) for x in range(2)], "case_id string, e long")
    c = ownership.cover(elems(spark, box("c", 1, 0, 0, 2, 2) + box("c", 2, 0, 0, 1, 1) + box("c", 3, 9, 9, 10, 10)), root).first()
    assert (c.overlap_excess, c.unassigned, c.exclusive) == (0.25, 0.0, False)
    g = ownership.geometry(elems(spark, box("c", 1, 2, 3, 6, 5)), F.lit(64)).first()
    assert (g.area, g.x0, g.y0, g.x1, g.y1, g.cx, g.cy) == (8, 2, 3, 6, 5, 3.5, 3.5)


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in assignment.solve(c))
        n, m = int(n), int(m)
        k = min(n, m)
        want = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.permutations(range(m), k))
        assert abs(got - want) < 1e-9 and len(assignment.solve(c)) == k


def test_scores_at_thresholds_and_ids(spark):
    truth = elems(spark, box("c", 1, 1, 1, 5, 5) + box("c", 2, 7, 7, 11, 11))
    pred = elems(spark, box("c", 8, 1, 1, 5, 5) + box("c", 9, 7, 7, 11, 11) + box("c", 10, 30, 30, 31, 31))
    got = {r.threshold: (r.precision, r.recall) for r in assignment.threshold_scores(pred, truth).collect()}
    assert len(got) == 11 and got[0.75] == (2 / 3, 1.0)
    prev = spark.createDataFrame([("c", 1, "wheel-01"), ("c", 2, "wheel-02")], "case_id string, set_id long, part_id string")
    pairs = overlap.cross_overlap(pred, truth).withColumn("score", F.col("iou"))
    ids = assignment.carry_ids(pred.select("case_id", "set_id").distinct(), prev, pairs)
    assert {r.set_id: r.part_id for r in ids.collect()} == {8: "wheel-01", 9: "wheel-02", 10: "part-03"}


def test_ids_beyond_99_stay_distinct(spark):
    x = spark.range(1, 121).select(F.lit("c").alias("case_id"), F.col("id").alias("set_id"))
    prev = x.withColumn("part_id", scores.numbered(F.lit("part"), ["case_id"], [F.col("set_id")]))
    assert {r.set_id: r.part_id for r in prev.collect()} == {k: f"part-{k:02d}" for k in range(1, 121)}
    pairs = spark.createDataFrame([("c", 200, 120, 1.0)], "case_id string, a long, b long, score double")
    now = spark.createDataFrame([("c", 200), ("c", 201)], "case_id string, set_id long")
    assert {r.set_id: r.part_id for r in assignment.carry_ids(now, prev, pairs).collect()} == {200: "part-120", 201: "part-121"}


def test_ordered_clusters_differ_from_components(spark):
    i = spark.createDataFrame([("c", k, k, 10.0 if k < 3 else 20.0) for k in range(4)], "case_id string, item long, place long, area double")
    p = spark.createDataFrame([("c", 0, 1, 0.9), ("c", 1, 2, 0.9), ("c", 2, 3, 0.9)], "case_id string, a long, b long, affinity double")
    take = lambda x: [r.cluster for r in x.orderBy("item").collect()]
    assert take(ordered.anchor_clusters(i, p, 0.5)) == [0, 0, 1, 1]
    assert take(ordered.first_match_clusters(i, p, 0.5)) == [0, 0, 0, 0]
    assert take(ordered.bounded_clusters(i, p, 0.5)) == [0, 0, 0, 1]


def test_mcnemar_is_exact_for_many_pairs():
    from fractions import Fraction

    for b, c in ((450, 560), (500, 501), (900, 1100), (20, 1500), (1000, 1000)):
        want = min(1.0, float(Fraction(2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c))))
        assert stats.mcnemar(b, c) == pytest.approx(want, rel=1e-9)
    assert 0 < stats.mcnemar(500_000_000, 500_040_000) < 1


def test_statistics(spark):
    d = spark.createDataFrame([(float(v),) for v in (-1, 1, -1, 1)], "difference double")
    b = stats.bootstrap(d, "difference", 2000, 7).first()
    assert b["mean"] == 0 and b["low"] <= 0 <= b["high"] and b["cases"] == 4
    assert stats.mcnemar(0, 0) == 1.0 and abs(stats.mcnemar(1, 9) - 0.021484375) < 1e-12
    x = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 4.0), (4.0, 9.0)], "x double, y double")
    want = pd.DataFrame({"x": [1, 2, 3, 4.0], "y": [2, 4, 4, 9.0]}).rank().corr().iloc[0, 1]
    assert abs(stats.spearman(x, "x", "y").first().rho - want) < 1e-12
    assert stats.spearman(x.withColumn("y", F.lit(1.0)), "x", "y").first().rho == 0.0
    rules = {"good": F.col("x") > 2, "bad": F.col("x") > 0}
    assert stats.select_rules(x, rules, F.col("x") > 2) == ["good"]
    w = x.agg(stats.wilson(F.count_if(F.col("x") > 2), F.count(F.lit(1))).alias("w")).first().w
    assert round(w.low, 4) == 0.15 and round(w.high, 4) == 0.85


def test_text(spark):
    x = spark.createDataFrame([("Front-Wheel = wheel | front wheel| wheel; hub,\n = ,x", 'say {no} {"a": 1, "b": {"c": 2}} tail {"d": 3}')], "p string, j string")
    r = x.select(text.prompt_items(F.col("p")).alias("i"), text.first_json_object(F.col("j")).alias("o"), text.slug(F.lit(" A--b C ")).alias("s"), text.shingles(F.lit("a b c d a b c"), 3).alias("g"), text.shingles(F.lit("a b"), 3).alias("n")).first()
    assert [(i.label, i.phrases) for i in r.i] == [("front_wheel", ["wheel", "front wheel"]), ("hub", ["hub"]), ("x", ["x"])]
    assert r.o == '{"a": 1, "b": {"c": 2}}' and r.s == "a_b_c" and sorted(r.g) == ["a b c", "b c d", "c d a", "d a b"] and r.n == []
    s = lambda a, b: x.select(text.phrase_score(F.lit(a), F.lit(b)).alias("s")).first().s
    assert s("front wheel", "front wheel") == 1.0 and s("the front wheel", "wheel") == 0.88 and s("wheel", "a wheel") == 0.86 and s("wheels", "wheel") == 0.0 and s("a b", "b c") == 1 / 3


def test_scores(spark):
    x = spark.createDataFrame([("a/b/grounding-dino-tiny/x", " ", None, 3)], "s string, d string, o string, i int")
    r = x.select(scores.source_family(F.col("s"), F.col("d")).alias("f"), scores.root_key(F.col("o"), F.col("i")).alias("k"), scores.root_key(F.col("o"), F.lit(None).cast("int")).alias("n"), scores.threshold_key(F.lit(0.25)).alias("t"), *(scores.version_at_least(F.lit(v), "0.3.8").alias(v.replace(".", "_")) for v in ("0.3.8", "0.10", "0.3", "x.1"))).first()
    assert (r.f, r.k, r.n, r.t) == ("a/b/grounding-dino", "legacy::3", None, "025") and (r["0_3_8"], r["0_10"], r["0_3"], r["x_1"]) == (True, True, False, False)
    y = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 5.0)], "g int, v double")
    w = Window.partitionBy("g")
    got = y.select("g", "v", scores.softmax(F.col("v"), w, 0.01).alias("p"), scores.min_max(F.col("v"), w).alias("m"), scores.hash_fraction(F.col("v"), "s").alias("h")).collect()
    assert {(r.g, r.v): r.m for r in got} == {(1, 1.0): 1.0, (1, 0.0): 0.0, (2, 5.0): 0.5} and all(0 <= r.h < 1 for r in got) and abs(sum(r.p for r in got) - 2) < 1e-12


def test_retrieval(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 2.0]), (4, 1, [0.0, 0.0])], "id long, label int, v array<double>")
    p = {r.label: r.prototype for r in retrieval.prototypes(v, "label", "v").collect()}
    assert abs(np.linalg.norm(p[0]) - 1) < 1e-9 and np.allclose(p[1], [0, 1])
    q = v.select(F.col("id").alias("query"), "v")
    h = retrieval.similar(q, v, 2)
    assert [r.id for r in h.where("query = 1").orderBy("rank").collect()] == [1, 2]
    assert {r["query"]: r.accepted for r in retrieval.label_route(h, min_score=0.5).collect()}[4] is False
    with pytest.raises(ValueError):
        retrieval.similar(q, v, 2, max_index_rows=3)
    assert abs(v.where("id = 2").select(vectors.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).first().c - 0.9 / np.hypot(0.9, 0.1)) < 1e-12


def test_validation(spark):
    sha = "a" * 64
    m = spark.createDataFrame([("a", 1, sha), ("b", 2, sha), ("b", 2, sha), ("../c", 1, sha), ("d", 1, sha), ("e", 1, "short"), ("f", 9, sha), ("g", 1, "b" * 64)], "path string, bytes long, sha256 string")
    f = spark.createDataFrame([(p, 1, sha) for p in ("a", "b", "e", "f", "g", "z")], "path string, bytes long, sha256 string")
    got = {r.path: r.error for r in validation.manifest_errors(m, f).collect()}
    assert got == {"b": "duplicate_path", "../c": "escaping_path", "d": "missing_file", "e": "malformed_sha256", "f": "byte_count", "g": "sha256", "z": "unlisted_file"}
    x = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, 7)], "id long, p long")
    assert [(r.key, r.rows) for r in validation.duplicate_keys(x, ["id"], "r").collect()] == [('{"id":1}', 2)]
    assert sorted((r.key, r.rows) for r in validation.orphans(x, "p", x.limit(0), "id", "r").collect()) == [("5", 2), ("7", 1)]
    assert {r.path: r.state for r in validation.differing_runs(f, f.where("path <> 'a'").withColumn("sha256", F.when(F.col("path") == "b", "x").otherwise(F.col("sha256")))).collect()} == {"a": "only_first", "b": "differs"}


def test_raster(spark):
    e = elems(spark, box("c", 1, 2, 2, 5, 5, 10) + [("c", 1, 9 * 10 + 9), ("c", 1, 5 * 10 + 5)])
    runs = raster.encode_runs(e, 10, 10)
    assert sum(runs.first().counts) == 100
    back = raster.decode_runs(runs.withColumn("width", F.lit(10)), "counts", F.lit(10))
    assert sorted(r.e for r in back.collect()) == sorted(r.e for r in e.collect())
    assert {r.n for r in raster.components(e, 10, 10).groupBy("component").agg(F.count("*").alias("n")).collect()} == {10, 1}
    assert raster.components(e, 10, 10, eight=False, least_area=2).select("component").distinct().count() == 1
    assert sorted(r.e for r in raster.erode(e, 10, 10).collect()) == [33]
    assert raster.dilate(elems(spark, [("c", 1, 0)]), 10, 10).count() == 4
    assert raster.boundary_f1(e, e, 10, 10).first().boundary_f1 == 1.0
    o = elems(spark, box("c", 1, 0, 0, 2, 2, 10) + box("c", 2, 2, 0, 4, 2, 10))
    assert [(r.a, r.b, r.length) for r in raster.adjacency(o, 10).collect()] == [(1, 2, 2)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"case_id": "a", "candidate_index": 0, "semantic_name": "x", "score": 0.5}\n')
    assert readers.candidates(spark, str(tmp_path / "c.json")).first().score == 0.5
    (tmp_path / "bad.json").write_text('{"case_id": "a", "candidate_index": 7, "semantic_name": " ", "score": 0.5}\n')
    with pytest.raises(Exception, match="bad candidate 7"):
        readers.candidates(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "b.csv").write_text("﻿id,v\n1,2\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "b.csv")).columns == ["id", "v"]
    (tmp_path / "a.json").write_text('{"categories": [{"id": 1, "name": "car"}, {"id": 2, "name": "car:wheel"}, {"id": 3, "name": "car:door"}], "images": [{"id": 1, "width": 9, "height": 9}], "annotations": [{"id": 10, "image_id": 1, "category_id": 1, "obj_ann_id": 10, "bbox": [0.0, 0.0, 50.0, 60.0]}, {"id": 11, "image_id": 1, "category_id": 2, "obj_ann_id": 10, "bbox": [0.0, 0.0, 5.0, 5.0]}, {"id": 12, "image_id": 1, "category_id": 3, "obj_ann_id": 10, "bbox": [0.0, 0.0, 5.0, 5.0]}, {"id": 13, "image_id": 1, "category_id": 1, "obj_ann_id": 13, "bbox": [0.0, 0.0, 50.0, 60.0]}]}')
    assert [(r.name, r.id, r.parts) for r in readers.annotations(spark, str(tmp_path / "a.json"), ["car"], 2, 40, 3).collect()] == [("car", 10, 2)]
    part = spark.createDataFrame([("c1", "p"), ("c2", "q")], "case_id string, part_id string")
    man = writers.package({"part": part}, str(tmp_path / "pkg"))
    assert man.count() >= 2 and validation.manifest_errors(man, readers.hashed_files(spark, str(tmp_path / "pkg")).join(man.select("path"), "path", "left_semi")).count() == 0
    got = readers.previous_package(spark, str(tmp_path / "pkg" / "part")).orderBy("part_id").first()
    assert (got.group_id, got.asset_id) == ("p", "object_001")
    base = spark.createDataFrame([("d", "x")], "domain string, part string")
    assert readers.merge_extension(base, spark.createDataFrame([("d", "y")], "domain string, part string"), ["domain", "part"], "domain").count() == 2
    for bad in (("d", "x"), ("e", "y")):
        with pytest.raises(ValueError):
            readers.merge_extension(base, spark.createDataFrame([bad], "domain string, part string"), ["domain", "part"], "domain")


def test_stream_windows_agree_with_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.sql("SELECT id AS event_id, timestamp_seconds(id * 400) AS ts, id % 3 AS k, CAST(id AS DOUBLE) AS value FROM range(50)").write.parquet(src)
    batch = spark.read.parquet(src)
    stream = windows.tumbling(spark.readStream.schema(batch.schema).parquet(src), "1 hour", ["k"], "value")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, windows.tumbling(batch, "1 hour", ["k"], "value").collect()))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == want and want
    assert windows.sessions(batch, "10 minutes", "k").count() == 50 and windows.first_seen(batch.union(batch), "event_id").count() == 50


def test_regions(spark):
    e = elems(spark, box("c", 1, 0, 0, 20, 2) + box("c", 2, 0, 10, 5, 15))
    s = {r.set_id: r.elongation for r in regions.shape(e, F.lit(64)).collect()}
    assert s[1] > 8 and abs(s[2] - 1) < 1e-6
    x = spark.createDataFrame([(1.0, 1), (1.1, 1), (9.0, 1), (2.0, 2), (2.1, 2)], "v double, k int")
    assert {(r.v, r.side) for r in regions.log_gap_split(x, "k", "v", 0.5).collect()} == {(1.0, "low"), (1.1, "low"), (9.0, "high"), (2.0, "low"), (2.1, "low")}
    o = spark.createDataFrame([("c", "g1", "a", 9), ("c", "g2", "a", 8), ("c", "g2", "b", 1), ("c", "g1", "d", 2), ("c", "g3", "a", 1)], "case_id string, group_id string, part_id string, n long")
    assert {(r.group_id, r.part_id) for r in regions.rebind(o).collect()} == {("g1", "a"), ("g2", "b"), ("g3", "a"), ("g1", "d")}
    g = spark.createDataFrame([("r", "wheel", False), ("r", "door", False), ("r", "x", True), ("q", "y", True)], "root string, semantic string, generic boolean")
    assert sorted(r.semantic for r in regions.ensemble_gate(g, 2).collect()) == ["door", "wheel", "y"]
    p = spark.createDataFrame([("c", "a", "wheel", 2, "p2", 0, 0, 4, 4, 16), ("c", "a", "wheel", 1, "p1", 8, 0, 12, 4, 16)], "case_id string, asset_id string, semantic string, instance_index int, part_id string, x0 int, y0 int, x1 int, y1 int, area long")
    r = regions.groups(p).first()
    assert r.members == ["p1", "p2"] and tuple(r.bbox) == (0, 0, 12, 4) and r.area == 32
    c = spark.createDataFrame([(1, "a", "A", 0.5), (1, "b", "B", 0.5)], "item int, label string, parent string, p double")
    q = spark.createDataFrame([(1, "A", 0.8), (1, "B", 0.2)], "item int, parent string, p double")
    assert {v.label: round(v.probability, 6) for v in regions.conditioned(c, q, 1.0).collect()} == {"a": 0.8, "b": 0.2}
    one = spark.range(1)
    t = one.select(regions.nearest_colour(F.lit(250), F.lit(3), F.lit(0), [(0, 0, 0), (255, 0, 0), (255, 0, 0)]).alias("n"), regions.canonical(F.lit("tyre"), {}, {"tyre": "wheel"}).alias("w"), regions.completion_reason(F.lit(0.9), F.lit(0.9), F.lit(0.5), F.lit(10.0), F.lit(100.0), F.lit(1.0), F.lit(1.0)).alias("r"), regions.compose(F.lit(False), F.lit(True), F.lit(1), F.lit(2)).alias("v")).first()
    assert tuple(t) == (1, "wheel", "proposal_leaks_outside_occluder_search", 2)


def test_parents_priors_routing_and_audits(spark):
    e = elems(spark, box("c", 1, 0, 0, 10, 10) + box("c", 2, 0, 0, 6, 6) + box("c", 3, 1, 1, 3, 3))
    got = {r.child: (r.parent, r.depth) for r in parents.enclosing(overlap.overlap_pairs(e)).collect()}
    assert got == {2: (1, 1), 3: (2, 2)}
    assert {(r.a, r.b) for r in overlap.containment_pairs(e, 0.9).collect()} == {(1, 2), (1, 3), (2, 3)}
    r = spark.createDataFrame([(1, "hub", None), (2, "wheel", None), (3, "car", 1)], "item long, semantic string, assembly_parent long")
    links = spark.createDataFrame([("hub", "wheel"), ("wheel", "car")], "semantic string, parent string")
    assert {(x.item, x.other) for x in parents.non_occluders(r, links).collect()} == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (3, 1)}
    g = spark.range(1).select(priors.compatibility(F.array(F.lit(0.2), F.lit(0.5)), F.array(F.array(F.lit(0.8), F.lit(0.5))), F.array(F.lit(0.1), F.lit(0.1))).alias("c")).first().c
    assert abs(g - 1) < 1e-9  # mirrored
    a = spark.createDataFrame([("red car", "car", "road"), ("car", "auto", "road"), ("boat", "boat", "sea")], "alias string, label string, domain string")
    q = spark.createDataFrame([("red car",), ("a blue car",), ("car boat",), ("cart",)], "prompt string")
    got = {x.prompt: (x.label, round(x.score, 4), x.resolved) for x in routing.resolve_prompts(q, a).collect()}
    assert got == {"red car": ("car", 1.0, True), "a blue car": ("auto", round(0.84 + 0.08 / 3, 4), True), "car boat": ("boat", 0.88, False)}
    p = spark.createDataFrame([("c", "p1", None, "g1"), ("c", "p1", "p9", "g2")], "case_id string, part_id string, parent_id string, group_id string")
    m = spark.createDataFrame([("c", "g1", "p1"), ("c", "g1", "p7")], "case_id string, group_id string, member_id string")
    assert tuple(evaluation.identity_audit(p, m).first())[1:] == (1, 1, 1, 1)
    o = spark.createDataFrame([("c", 4, 4, 4, 4, 0, 4)], "case_id string, visible long, full long, completed long, both_full long, added_hidden long, kept_visible long")
    assert tuple(evaluation.occlusion(o).first())[1:] == (1.0, 1.0, 1.0, 1.0, 0.0, 1.0)
