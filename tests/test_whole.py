"""Queries on small tables of their own: results that don't depend on the order of rows, and pixels that aren't shuffled."""

import numpy as np
import pytest

from loomgrid.operators import envelopes, partition
from loomgrid.plans import catalog, measures, rasters, shapes  # noqa: F401  (register their queries)


def test_plans_scores_are_exact_means(spark, tmp_path):
    # 256 rows whose cents sum to c have the mean 10 c / 256 - 49.5, a tie in the sixth decimal for odd c
    cents = {0: 1309, 1: 1313, 2: 1361, 3: 1303}
    rows = [(s, "N", (c // 256 + (k < c % 256)) / 100) for s, c in cents.items() for k in range(256)]
    for n, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: hash((r[2] * 7919) % 1)))):
        spark.createDataFrame(order, "l_suppkey long, l_returnflag string, l_discount double").coalesce(1 + n).write.parquet(str(tmp_path / f"{n}/lineitem.parquet"))
        got = {r.plan: r.score for r in measures.unmatched_plans(spark, str(tmp_path / f"{n}")).collect()}
        # of one region the best plan takes it: 1361 * 10 / 256 - 49.5 = 3.6640625
        assert got == {0: None, 1: None, 2: 3.664063, 3: None}


def fail(*_, **__):
    raise AssertionError("a table is written")


def shuffles(df):
    """Columns of the shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("Exchange ")[1] for x in plan.splitlines() if "Exchange " in x and "Reused" not in x]


def drawings(rng, n, h=48, w=64):
    masks = np.zeros((n, h, w), bool)
    for k, m in enumerate(masks):
        for _ in range(1 + k % 4):
            y, x = rng.integers(0, h - 9), rng.integers(0, w - 12)
            m[y : y + rng.integers(1, 10), x : x + rng.integers(1, 13)] = True
        if k % 9 == 0:
            m |= rng.random((h, w)) < 0.01
    return masks


def test_candidates_of_many_masks_are_those_of_each():
    masks = drawings(np.random.default_rng(1), 60)
    masks[:3] = False
    for k in range(3):
        masks[k, 4, 5 : 6 + 4 * k] = True
    found = envelopes.candidates_of_masks(masks)
    for k, m in enumerate(masks):
        want = envelopes.candidates_of(m)
        for at, kind in enumerate(envelopes.KINDS):
            assert (found[at, k] == envelopes.limited(want[kind], m)).all()


def test_completion_neither_writes_nor_shuffles_pixels(spark, monkeypatch):
    monkeypatch.setattr(envelopes, "materialize", fail, raising=False)
    got = shapes.completed_sets(spark, "/root/testdata/sf0.001")
    assert got.count() > 500
    assert not [x for x in shuffles(got) if "e#" in x]


@pytest.mark.parametrize("name", ["surface_merges", "face_merges"])
def test_pairs_of_surfaces_leave_one_kernel(spark, monkeypatch, name):
    written = []
    keep = lambda df, label, compact=False: written.append((label, shuffles(df))) or df
    monkeypatch.setattr(partition, "materialize", keep)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    # pixels are shuffled as orders only, and one table of pairs is written
    assert [label for label, _ in written] == ["surfaces"]
    assert not [x for x in written[0][1] if ", e#" in x or "(e#" in x]


def test_alignment_shuffles_rows_of_tables_only(spark):
    got = shapes.aligned_outlines(spark, "/root/testdata/sf0.001")
    assert got.count() > 100
    # once customers, once orders
    assert len(shuffles(got)) == 2


def test_alignment_of_images_is_that_of_tiles(spark):
    from loomgrid.operators import tiles

    rng = np.random.default_rng(2)
    w, h, size = 23, 17, 9
    values = {c: rng.random((2, h, w)).astype(np.float32) * (c > 0) for c in range(4)}
    sets = {(c, s): rng.random(h * w) < p for c in range(4) for s, p in enumerate((0.02, 0.5, 1.0))}
    elem = spark.createDataFrame([(c, s, int(e)) for (c, s), m in sets.items() for e in np.flatnonzero(m)], "case_id int, set_id int, e long")
    pixels = spark.createDataFrame([(c, k, *map(float, v.reshape(2, -1)[:, k])) for c, v in values.items() for k in range(h * w)], "case_id int, e long, p double, q double")
    images = spark.createDataFrame([(c, v.ravel().tolist()) for c, v in values.items()], "case_id int, values array<float>")
    strength = tiles.to_pixels(tiles.edge_strength(tiles.to_tiles(pixels, ["p", "q"], w, h, size), 2, w, h, size), w, size)
    want = {(r.case_id, r.set_id): round(r.alignment, 9) for r in tiles.boundary_alignment(strength, elem, w, h).collect()}
    assert {(r.case_id, r.set_id): round(r.alignment, 9) for r in tiles.image_alignment(images, elem, 2, w, h).collect()} == want


def test_shapes_of_whole_sets_are_those_of_joins(spark, monkeypatch):
    masks = drawings(np.random.default_rng(4), 40, 30, 40)
    masks[0], masks[1] = True, False
    masks[1, 3, 4:9] = True
    elem = spark.createDataFrame([(k // 2, k % 2, int(e)) for k, m in enumerate(masks) for e in np.flatnonzero(m)], "case_id int, set_id int, e long")
    seen = elem.selectExpr("case_id", "set_id", "e % 40 div 12 AS visual", "e")
    written = []
    keep = partition.materialize
    with monkeypatch.context() as m:
        m.setattr(partition, "materialize", lambda df, label, **k: written.append(label) or keep(df, label, **k))
        got = [sorted(map(tuple, partition.shape_regions(elem, 40, 30, v).collect())) for v in (None, seen)]
    assert written == ["large"] * 2
    monkeypatch.setattr(partition, "FLOOD_WHOLE", 100)
    want = [sorted(map(tuple, partition.shape_regions(elem, 40, 30, v).collect())) for v in (None, seen)]
    near = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    assert list(map(near, got)) == list(map(near, want)) and got[0]


def test_agreement_counts_pairs_of_any_overlap(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    # a short text inside a long one, of IoU below 0.3, and two that share one shingle of many
    rows = [(0, " ".join(words), "en", "a"), (1, " ".join(words[:6]), "en", "b"), (2, "w0 w1 w2 x1 x2 x3 x4 x5 x6 x7 x8 x9", "en", "a"), (3, " ".join(words), "de", "c"), (4, "y1 y2 y3", None, "c"), (5, "y1 y2 y3", None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.set_id: r.agreement for r in catalog.agreement(spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.25, 3: 0.0, 4: 0.0, 5: 0.0}
