"""Convex envelopes, completions and tiled stencils against whole-image computations."""

import random

import numpy as np
import pytest

from loomgrid.operators import envelopes, tiles

W, H = 37, 29


def inside_hull(points, x, y):
    """A point is in the hull unless some line through two points has all points on the other side."""
    if (x, y) in points:
        return True
    pts = sorted(points)
    for a in pts:
        for b in pts:
            if a != b and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in pts) and (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) < 0:
                return False
    if all((pts[-1][0] - pts[0][0]) * (p[1] - pts[0][1]) == (pts[-1][1] - pts[0][1]) * (p[0] - pts[0][0]) for p in pts):
        (x0, y0), (x1, y1) = pts[0], pts[-1]
        return (x1 - x0) * (y - y0) == (y1 - y0) * (x - x0) and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1)
    return True


def test_hulls(spark):
    rng, rows, want = random.Random(3), [], {}
    for c in range(30):
        pts = {(rng.randrange(14), rng.randrange(12)) for _ in range(rng.randrange(1, 9))}
        if c == 0:
            pts = {(2, 2), (5, 8)}  # a line that meets no other whole point
        if c == 1:
            pts = {(0, 0), (4, 4), (2, 2)}
        rows += [(c, "s", y * W + x) for x, y in pts]
        want[c] = {y * W + x for x in range(14) for y in range(12) if inside_hull(pts, x, y)}
    got = {}
    for r in envelopes.convex_hull(spark.createDataFrame(rows, "case_id int, set_id string, e long"), W).collect():
        got.setdefault(r.case_id, set()).add(r.e)
    assert got == want
    hosts = spark.createDataFrame([(c, "h", e) for c, _, e in rows], "case_id int, host string, e long")
    probes = spark.createDataFrame([(c, "p", e) for c in want for e in range(0, 5 * W, 3)], "case_id int, set_id string, e long")
    shares = {r.case_id: r.share for r in envelopes.envelope_shares(probes, hosts, W).collect()}
    assert shares == pytest.approx({c: n for c, v in want.items() if (n := len(v & set(range(0, 5 * W, 3))) / len(range(0, 5 * W, 3)))})


def spread(mask, offsets):
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for a, b in offsets:
            if 0 <= y + a < H and 0 <= x + b < W:
                out[y + a, x + b] = True
    return out


def whole(mask, occupied):
    """Added pixels and confidence of one set."""
    square = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    touching = int((spread(mask, square) & ~mask & occupied).sum())
    if touching < max(3, round(mask.sum() * 0.002)):
        return np.zeros_like(mask), touching, 1.0
    found = [envelopes.limited(c, mask) for c in envelopes.candidates_of(mask).values()]
    votes = np.sum(found, axis=0)
    added = (votes >= 3) & spread(mask, envelopes.disc(31)) & ~mask
    if not added.any():
        score = [((c & ~mask & occupied).sum() / max(1, (c & ~mask).sum())) - 0.15 * abs(c.sum() / mask.sum() - 1.35) for c in found[1:]]
        added = found[1 + int(np.argmax(np.round(score, 12)))] & ~mask
    any_ = (votes > 0) & ~mask
    spread_ = np.mean(np.var(np.stack(found)[:, any_].astype(float), axis=0)) if any_.any() else 0.0
    hits = (added & occupied).sum() / max(1, added.sum())
    return added, touching, float(np.clip(0.7 * (1 - 4 * spread_) + 0.3 * hits, 0.05, 0.95))


def test_completions(spark):
    rng, rows, want = random.Random(4), [], {}
    for c in range(6):
        owner = np.zeros((H, W), int)
        for s in range(1, 5):
            y, x, h, w = rng.randrange(H - 4), rng.randrange(W - 4), rng.randrange(2, 12), rng.randrange(2, 12)
            owner[y : y + h, x : x + w] = s
        rows += [(c, int(owner.flat[e]), int(e)) for e in np.flatnonzero(owner)]
        for s in set(owner[owner > 0].tolist()):
            mask = owner == s
            added, touching, sure = whole(mask, (owner > 0) & ~mask)
            want[c, s] = (set(np.flatnonzero(mask | added).tolist()), int(mask.sum()), int(added.sum()), touching, round(sure, 9))
    sets = spark.createDataFrame(rows, "case_id int, set_id int, e long")
    full, figures = envelopes.complete(sets, sets, W, H)
    got = {}
    for r in full.collect():
        got.setdefault((r.case_id, r.set_id), set()).add(r.e)
    found = {(r.case_id, r.set_id): (got[r.case_id, r.set_id], r.visible, r.added, r.touching, round(r.confidence, 9)) for r in figures.collect()}
    assert found == want and sum(v[2] > 0 for v in want.values()) > 5 and any(v[4] == 1.0 for v in want.values())


def test_candidates_keep_what_is_visible():
    mask = np.zeros((24, 32), bool)
    mask[7:18, 4:14] = True
    for name, c in envelopes.candidates_of(mask).items():
        assert name == "ellipse" or (c & mask).sum() == mask.sum(), name
        assert envelopes.limited(c, mask).sum() <= 2.5 * mask.sum() and (envelopes.limited(c, mask) & mask).sum() == mask.sum()
    assert len(envelopes.disc(3)) == 5 and max(b for _, b in envelopes.disc(31)) == 15


@pytest.mark.parametrize("size", [5, 8, 64])
def test_stencils_cross_tiles(spark, size):
    rng = np.random.default_rng(1)
    images = {c: rng.random((2, H, W)).astype(np.float32) for c in ("one", "two")}
    rows = [(c, int(k), float(a[0].flat[k]), float(a[1].flat[k])) for c, a in images.items() for k in range(H * W)]
    t = tiles.to_tiles(spark.createDataFrame(rows, "case_id string, e long, u double, v double"), ["u", "v"], W, H, size)

    def mean(a):
        n, m = a.shape[1] - 4, a.shape[2] - 4
        return sum(a[:1, i : i + n, j : j + m] * (1 + i) - a[1:, i : i + n, j : j + m] * j for i in range(5) for j in range(5))

    got = {(r.case_id, r.e): r.value for r in tiles.to_pixels(tiles.stencil(t, mean, 2, 2, W, H, size), W, size).collect()}
    for c, a in images.items():
        want = mean(np.pad(a, ((0, 0), (2, 2), (2, 2)), mode="reflect"))[0]
        assert np.allclose([[got[c, y * W + x] for x in range(W)] for y in range(H)], want, atol=1e-4)
    strength = tiles.to_pixels(tiles.edge_strength(t, 2, W, H, size), W, size)
    assert strength.count() == 2 * H * W


def test_alignment_of_a_set_on_an_edge(spark):
    step = spark.createDataFrame([(1, y * W + x, 100.0 if 10 <= x < 20 and 8 <= y < 18 else 0.0) for y in range(H) for x in range(W)], "case_id int, e long, v double")
    strength = tiles.to_pixels(tiles.edge_strength(tiles.to_tiles(step, ["v"], W, H, 16), 1, W, H, 16), W, 16)
    sets = [(1, 1, y * W + x) for y in range(8, 18) for x in range(10, 20)] + [(1, 2, y * W + x) for y in range(21, 26) for x in range(25, 33)] + [(2, 3, 0)]
    sets += [(1, 4, k) for k in range(W * H)]
    got = {r.set_id: r.alignment for r in tiles.boundary_alignment(strength, spark.createDataFrame(sets, "case_id int, set_id int, e long"), W, H).collect()}
    assert got[1] == 1.0 and got[2] < 0.05 and got[3] == 0.0 == got[4]
