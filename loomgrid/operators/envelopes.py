"""Convex envelopes of element sets, what lies in them, and completions of partly hidden sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster


def hull_rows(extents: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(y, first, last) of the whole points in the convex hull of rows (y, x0, x1), for every y between them."""
    rows = sorted(extents)
    if not rows:
        return []

    def chain(points: list[tuple[int, int]], sign: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for y, x in points:
            while len(out) > 1 and sign * ((out[-1][0] - out[-2][0]) * (x - out[-2][1]) - (out[-1][1] - out[-2][1]) * (y - out[-2][0])) <= 0:
                out.pop()
            out.append((y, x))
        return out

    left, right = chain([(y, a) for y, a, _ in rows], 1), chain([(y, b) for y, _, b in rows], -1)
    out, i, j = [], 0, 0
    for y in range(rows[0][0], rows[-1][0] + 1):
        while i + 1 < len(left) - 1 and left[i + 1][0] <= y:
            i += 1
        while j + 1 < len(right) - 1 and right[j + 1][0] <= y:
            j += 1

        def at(c, k):  # numerator and denominator of the side's x
            (y0, x0), (y1, x1) = c[k], c[min(k + 1, len(c) - 1)]
            return (x0 * (y1 - y) + x1 * (y - y0), y1 - y0) if y1 > y0 else (x0, 1)

        (a, m), (b, n) = at(left, i), at(right, j)
        if -(-a // m) <= b // n:
            out.append((y, -(-a // m), b // n))
    return out


def convex_rows(elem: DataFrame, width: int) -> DataFrame:
    """(case_id, set_id, y, x0, x1): rows of each set's convex hull, both ends included.

    Only the outermost elements of a row can be corners. These merge, so a set of any area meets as its rows' extents.
    """
    kinds = dict(elem.dtypes)
    x = F.col("e") % width
    ends = elem.groupBy("case_id", "set_id", F.floor(F.col("e") / width).alias("y")).agg(F.min(x).alias("x0"), F.max(x).alias("x1"))

    def run(batches):
        for t in batches:
            out = [(case, name, *r) for case, name, *rows in zip(t["case_id"], t["set_id"], t["y"], t["x0"], t["x1"]) for r in hull_rows(list(zip(*(a.tolist() for a in rows))))]
            yield pd.DataFrame(out, columns=["case_id", "set_id", "y", "x0", "x1"])

    return raster.gathered(ends, "case_id", "set_id", y="y", x0="x0", x1="x1").mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, y long, x0 long, x1 long")


def convex_hull(elem: DataFrame, width: int) -> DataFrame:
    """(case_id, set_id, e) of all pixels in each set's convex hull."""
    r = convex_rows(elem, width).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return r.select("case_id", "set_id", (F.col("y") * width + F.col("x")).alias("e"))


def envelope_shares(elem: DataFrame, hosts: DataFrame, width: int) -> DataFrame:
    """(case_id, set_id, host, share): how much of each set lies in the convex hulls of its case's hosts (case_id, host, e), where any does."""
    kinds = dict(elem.dtypes) | {"host": dict(hosts.dtypes)["host"]}
    hulls = convex_rows(hosts.withColumnRenamed("host", "set_id"), width).withColumnRenamed("set_id", "host")
    rows = raster.together(sets=raster.gathered(elem, "case_id", "set_id", e="e"), hulls=raster.gathered(hulls, "case_id", "host", y="y", x0="x0", x1="x1")).where("sets IS NOT NULL AND hulls IS NOT NULL")

    def run(batches):
        for t in batches:
            out = []
            for case, sets, hulls in zip(t["case_id"], t["sets"], t["hulls"]):
                points = [(s["set_id"], *np.divmod(np.asarray(s["e"], int), width)) for s in sets]
                height = 1 + max(int(max(y.max() for _, y, _ in points)), *(int(np.max(h["y"])) for h in hulls))
                for h in hulls:
                    # rows without a part of the hull have none between their ends
                    a, b = np.ones(height, int), np.zeros(height, int)
                    a[h["y"]], b[h["y"]] = h["x0"], h["x1"]
                    for name, y, x in points:
                        held = int(((a[y] <= x) & (x <= b[y])).sum())
                        if held:
                            out.append((case, name, h["host"], held / len(x)))
            yield pd.DataFrame(out, columns=["case_id", "set_id", "host", "share"])

    return rows.mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, host {kinds['host']}, share double")


# -- completion --


def disc(size: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse as wide and high as ``size`` (odd)."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for half in [int(np.rint(r * math.sqrt((r * r - dy * dy) / (r * r)))) if r else 0] for dx in range(-half, half + 1)]


def _moved(mask: np.ndarray, offsets: list[tuple[int, int]], outside: bool) -> list[np.ndarray]:
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    wide = np.pad(mask, r, constant_values=outside)
    h, w = mask.shape
    return [wide[r + a : r + a + h, r + b : r + b + w] for a, b in offsets]


def closed(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Dilation, then erosion, by a symmetric set of offsets; beyond the border is background to the first and object to the second."""
    grown = np.logical_or.reduce(_moved(mask, offsets, False))
    return np.logical_and.reduce(_moved(grown, offsets, True))


def _axes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, variances (small first) and directions (columns) of points."""
    values, vectors = np.linalg.eigh(np.cov(np.stack([x, y]).astype(float)))
    return np.array([x.mean(), y.mean()]), values, vectors


def candidates_of(mask: np.ndarray) -> dict[str, np.ndarray]:
    """What a set may look like without what hides it: itself, closed by a small and a larger disc, its convex hull, an ellipse of its moments, and
    itself with its mirror image about the main axis. Fixed values: factors and least counts."""
    h, w = mask.shape
    y, x = np.nonzero(mask)
    out = {"visible": mask}
    radius = max(2, round(min(np.ptp(x) + 1, np.ptp(y) + 1) * 0.10))
    for name, factor in (("closed", 1.0), ("widely closed", 1.8)):
        out[name] = closed(mask, disc(max(3, 2 * round(radius * factor) + 1)))
    hull = np.zeros_like(mask)
    for row in np.unique(y):
        own = x[y == row]
        hull[row, [own.min(), own.max()]] = True
    ends = [(int(r), int(np.flatnonzero(hull[r])[0]), int(np.flatnonzero(hull[r])[-1])) for r in np.unique(y)]
    for r, a, b in hull_rows(ends):
        hull[r, a : b + 1] = True
    out["convex"] = hull | mask
    out["ellipse"] = out["mirrored"] = mask
    ys, xs = np.mgrid[0:h, 0:w]
    if len(x) >= 12:
        centre, values, vectors = _axes(x, y)
        along = np.tensordot(vectors.T, np.stack([xs - centre[0], ys - centre[1]]), 1)
        reach = np.maximum(1.0, 2.45 * np.sqrt(np.maximum(values, 1.0)))
        out["ellipse"] = ((along / reach[:, None, None]) ** 2).sum(0) <= 1
    if len(x) >= 8:
        centre, _, vectors = _axes(x, y)
        p = np.stack([x, y]).T - centre
        q = np.rint(centre + 2 * (p @ vectors[:, 1:]) * vectors[:, 1] - p).astype(int)
        q = q[(q >= 0).all(1) & (q[:, 0] < w) & (q[:, 1] < h)]
        both = mask.copy()
        both[q[:, 1], q[:, 0]] = True
        out["mirrored"] = closed(both, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return out


def limited(candidate: np.ndarray, mask: np.ndarray, ratio: float = 2.5) -> np.ndarray:
    """``candidate`` and the set; if that is more than ``ratio`` times the set, only what is among as many pixels nearest to it (ties in reading order)."""
    most, out = round(int(mask.sum()) * ratio), candidate | mask
    if out.sum() <= most:
        return out
    near = np.argsort(raster.distance_transform(~mask).ravel(), kind="stable")[:most]
    allowed = np.zeros(mask.size, bool)
    allowed[near] = True
    return (out & allowed.reshape(mask.shape)) | mask


def _disc_grown(masks: np.ndarray, size: int) -> np.ndarray:
    """Masks (n, h, w) grown by ``disc(size)``; beyond the border is nothing."""
    n, h, w = masks.shape
    half: dict[int, int] = {}
    for dy, dx in disc(size):
        half[dy] = max(half.get(dy, 0), dx)
    wide, rows = {0: masks}, masks
    for k in range(1, max(half.values()) + 1):
        rows = rows.copy()
        rows[:, :, k:] |= masks[:, :, : max(0, w - k)]
        rows[:, :, : max(0, w - k)] |= masks[:, :, k:]
        wide[k] = rows
    out = np.zeros_like(masks)
    for dy, dx in half.items():
        if abs(dy) < h:
            out[:, max(0, -dy) : h - max(0, dy)] |= wide[dx][:, max(0, dy) : h + min(0, dy)]
    return out


def _closed_masks(masks: np.ndarray, size: int) -> np.ndarray:
    return ~_disc_grown(~_disc_grown(masks, size), size)


#: Candidates but the set itself, in the order in which equally good ones are taken.
KINDS = ("closed", "widely closed", "convex", "ellipse", "mirrored")


def candidates_of_masks(masks: np.ndarray) -> np.ndarray:
    """(len(KINDS), masks, h, w): ``candidates_of`` of many non-empty masks, each limited in size by ``limited``."""
    n, h, w = masks.shape
    out = np.broadcast_to(masks, (len(KINDS), n, h, w)).copy()
    ys, xs = np.mgrid[0:h, 0:w]
    cols, rows = masks.any(1), masks.any(2)
    span = lambda a: a.shape[1] - a[:, ::-1].argmax(1) - a.argmax(1)
    radius = [max(2, round(int(k) * 0.10)) for k in np.minimum(span(cols), span(rows))]
    for at, factor in enumerate((1.0, 1.8)):
        sizes = np.array([max(3, 2 * round(r * factor) + 1) for r in radius])
        for size in np.unique(sizes):
            of = sizes == size
            out[at, of] = _closed_masks(masks[of], int(size))
    first, last = masks.argmax(2), w - 1 - masks[:, :, ::-1].argmax(2)
    area = masks.sum((1, 2))
    for k, m in enumerate(masks):
        there = np.flatnonzero(rows[k])
        for r, a, b in hull_rows(list(zip(there.tolist(), first[k, there].tolist(), last[k, there].tolist()))):
            out[2, k, r, a : b + 1] = True
        if area[k] < 8:
            continue
        y, x = np.nonzero(m)
        centre, values, vectors = _axes(x, y)
        if area[k] >= 12:
            along = np.tensordot(vectors.T, np.stack([xs - centre[0], ys - centre[1]]), 1)
            reach = np.maximum(1.0, 2.45 * np.sqrt(np.maximum(values, 1.0)))
            out[3, k] |= ((along / reach[:, None, None]) ** 2).sum(0) <= 1
        p = np.stack([x, y]).T - centre
        q = np.rint(centre + 2 * (p @ vectors[:, 1:]) * vectors[:, 1] - p).astype(int)
        q = q[(q >= 0).all(1) & (q[:, 0] < w) & (q[:, 1] < h)]
        out[4, k, q[:, 1], q[:, 0]] = True
    many = area >= 8
    out[4, many] = ~raster.grown(~raster.grown(out[4, many], 1), 1)
    out |= masks
    # what is too large keeps what is among so many pixels nearest to the set
    most = np.array([round(int(a) * 2.5) for a in area])
    large = out.sum((2, 3)) > most
    some = np.flatnonzero(large.any(0))
    if len(some):
        d = raster.squared_distances(~masks[some]).reshape(len(some), -1)
        for k, own in zip(some, d):
            allowed = np.zeros(h * w, bool)
            allowed[np.argsort(own, kind="stable")[: most[k]]] = True
            out[large[:, k], k] &= allowed.reshape(h, w) | masks[k]
    return out


def _completed(masks: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """Pixels that each mask gains and its measures; ``other``: what others occupy of each one's image."""
    n = len(masks)
    visible = masks.sum((1, 2))
    touching = (raster.grown(masks, 2) & ~masks & other).sum((1, 2))
    open_ = touching >= np.maximum(3, np.rint(visible * 0.002))
    added, sure = np.zeros_like(masks), np.ones(n)
    at = np.flatnonzero(open_)
    if len(at):
        own, held = masks[at], other[at]
        found = candidates_of_masks(own)
        votes = found.sum(0, dtype=np.int8)
        votes[own] = 0
        gains = (votes >= 3) & _disc_grown(own, 31)
        # sets on which nothing is agreed take their best candidate
        rest = np.flatnonzero(~gains.any((1, 2)))
        if len(rest):
            extra = found[:, rest] & ~own[rest]
            hits, more, area = (extra & held[rest]).sum((2, 3)), extra.sum((2, 3)), visible[at][rest]
            score = hits / np.maximum(1, more) - 0.15 * np.abs((more + area) / area - 1.35)
            gains[rest] = extra[np.round(score, 12).argmax(0), np.arange(len(rest))]
        # the variance of six votes of 0 or 1, over pixels that any candidate adds
        counts = np.stack([(votes == k).sum((1, 2)) for k in range(1, 6)])
        share = np.arange(1, 6) / 6
        spread = (counts * (share * (1 - share))[:, None]).sum(0) / np.maximum(1, counts.sum(0))
        supported = (gains & held).sum((1, 2)) / np.maximum(1, gains.sum((1, 2)))
        sure[at] = np.clip(0.70 * (1 - 4 * spread) + 0.30 * supported, 0.05, 0.95)
        added[at] = gains
    return added, pd.DataFrame({"visible": visible, "added": added.sum((1, 2)), "touching": touching, "confidence": sure})


def complete(elem: DataFrame, occupied: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Sets (case_id, set_id, e) completed behind what occupies (case_id, set_id, e: an exclusive map) their image.

    First result: (case_id, set_id, e) of the full sets; second: (case_id, set_id, visible, added, touching, confidence).
    A set that touches too few occupied pixels within two of it stays as it is. Else pixels that three candidates have
    and that lie within a disc of 31 of the set are added; if there are none, the candidate is taken whose additions are
    occupied most, for a size near 1.35 times the set's (ties: in the order of ``candidates_of``). Confidence falls with
    the candidates' disagreement and grows with the share of added pixels that are occupied. Fixed values: the numbers.
    An image's sets meet its map as one row; only what a set gains leaves the kernel.
    """
    kinds = dict(elem.dtypes)
    own = raster.gathered(elem.select("case_id", "set_id", "e").distinct(), "case_id", "set_id", e="e")
    rows = raster.together(own=own, other=raster.gathered(occupied, "case_id", "set_id", e="e")).where("own IS NOT NULL")
    most = max(1, raster.AT_ONCE // (8 * width * height))

    def run(batches):
        for t in batches:
            sets = [(case, s["set_id"], s["e"], other) for case, own, other in zip(t["case_id"], t["own"], t["other"]) for s in own]
            for k in range(0, len(sets), most):
                part = sets[k : k + most]
                held = np.zeros((len(part), height * width), bool)
                for h, (_, name, _, other) in zip(held, part):
                    for o in () if other is None else other:
                        if o["set_id"] != name:
                            h[np.asarray(o["e"], int)] = True
                added, x = _completed(raster.masks_of(pd.Series([e for _, _, e, _ in part]), width, height), held.reshape(-1, height, width))
                x.insert(0, "case_id", [r[0] for r in part])
                x.insert(1, "set_id", [r[1] for r in part])
                yield x.assign(gained=[np.flatnonzero(m) for m in added])

    x = rows.mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, visible long, added long, touching long, confidence double, gained array<long>")
    full = elem.select("case_id", "set_id", "e").distinct().unionByName(x.select("case_id", "set_id", F.explode("gained").alias("e")))
    return full, x.drop("gained")
