"""Partitions of element sets: shape bottlenecks by flooding, and merges of surfaces and faces, for all cases at once.

Elements are ``e = y * width + x`` of an image; sets are (case_id, set_id, e), regions of a case an exclusive map
(case_id, region, e). Kernels see one set of one image; everything between sets and regions is joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch, materialize
from . import graph, raster
from .validation import ladder


def _cropped(e: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int, int]:
    """The mask of ``e`` in its box, a pixel wider where the image goes on, and the box's corner."""
    y, x = np.divmod(e, width)
    y0, x0 = max(0, int(y.min()) - 1), max(0, int(x.min()) - 1)
    mask = np.zeros((min(height, int(y.max()) + 2) - y0, min(width, int(x.max()) + 2) - x0), bool)
    mask[y - y0, x - x0] = True
    return mask, y0, x0


def peaks(distance: np.ndarray, spacing: int, least: float, most: int) -> list[tuple[int, int]]:
    """Pixels above ``least`` that no pixel within ``spacing`` (of either coordinate) exceeds: highest first, ties in reading order, none nearer than ``spacing`` to one before it."""
    wide = np.pad(distance, spacing)
    top = np.maximum.reduce([wide[:, k : k + distance.shape[1]] for k in range(2 * spacing + 1)])
    top = np.maximum.reduce([top[k : k + distance.shape[0]] for k in range(2 * spacing + 1)])
    ys, xs = np.nonzero((distance == top) & (distance > least))
    found: list[tuple[int, int]] = []
    for k in np.lexsort((xs, ys, -distance[ys, xs])):
        if len(found) == most:
            break
        if all(max(abs(ys[k] - y), abs(xs[k] - x)) >= spacing for y, x in found):
            found.append((int(ys[k]), int(xs[k])))
    return found


def markers(elem: DataFrame, width: int, height: int, least_area: int = 64, spacing: float = 0.04, most: int = 14) -> DataFrame:
    """(case_id, set_id, e, distance, marker) of the sets of at least ``least_area`` elements: depth of each element in its set, and the number from 1
    of those that are peaks of depth, else null. ``spacing``: of peaks, in square roots of the area (four pixels at least)."""
    kinds = dict(elem.dtypes)

    def one(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, y0, x0 = _cropped(e, width, height)
        distance = raster.distance_transform(mask)
        distance = np.where(np.isfinite(distance), distance, float(max(width, height)))
        number = np.full(mask.shape, np.nan)
        found = peaks(distance, max(4, round(len(e) ** 0.5 * spacing)), max(2.0, 0.035 * float(distance.max())), most)
        for k, (y, x) in enumerate(found, 1):
            number[y, x] = k
        y, x = np.divmod(e, width)
        return distance[y - y0, x - x0], number[y - y0, x - x0]

    def run(batches):
        for t in batches:
            at = [np.unique(np.asarray(e, int)) for e in t["e"]]
            large = [len(e) >= least_area for e in at]
            at = [e for e, ok in zip(at, large) if ok]
            found = list(map(one, at))
            x = raster.spread(t[large], list(map(len, at)), e=at, distance=[d for d, _ in found], marker=[n for _, n in found])
            yield x.assign(marker=x["marker"].astype("Int32"))

    return raster.gathered(elem, "case_id", "set_id", e="e").mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, e long, distance double, marker int")


#: Sets of at most so many elements are flooded in one piece, many to a task.
FLOOD_WHOLE = 50_000


def flooded(e: np.ndarray, distance: np.ndarray, marker: np.ndarray, width: int) -> np.ndarray:
    """The marker whose water reaches each element first, nan where none can; ``flood`` of one set."""
    order = np.argsort(e)
    place = lambda at: (k := np.minimum(np.searchsorted(e, at, sorter=order), len(e) - 1), e[order[k]] == at)
    ends = []
    for step, ok in ((1, e % width < width - 1), (width, np.ones(len(e), bool))):
        k, there = place(e + step)
        ends.append(np.stack([np.flatnonzero(ok & there), order[k][ok & there]]))
    a, b = np.concatenate(ends, axis=1)
    way = np.lexsort((e[b], e[a], -np.minimum(distance[a], distance[b])))
    root, of = list(range(len(e))), marker.tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a[way].tolist(), b[way].tolist()):
        x, y = find(x), find(y)
        if x != y and not (of[x] == of[x] and of[y] == of[y]):
            if of[x] == of[x]:
                x, y = y, x
            root[x] = y
    return np.array([of[find(k)] for k in range(len(e))])


def flood(pixels: DataFrame, width: int) -> DataFrame:
    """(case_id, set_id, e, marker): each element with the marker whose water reaches it first; without one that can reach it, null.

    pixels: (case_id, set_id, e, distance, marker). Water rises from -distance; a pixel belongs to the marker that it is
    joined to by the path of lowest crest. That is the minimum spanning forest with a tree for each marker, which is
    grown for all images at once: in every round each fragment without a marker takes its lowest edge, and fragments
    that meet become one. Edges are ordered by crest, then by their pixels in reading order, so the result is unique.
    Rounds are at most the logarithm of the longest basin; edges and fragments at least halve. Sets of at most
    FLOOD_WHOLE elements take the same edges in order, a set at a time.
    """
    on, kinds = ["case_id", "set_id"], dict(pixels.dtypes)
    px = materialize(pixels.select(*on, "e", "distance", "marker"), "pixels")
    large = materialize(px.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FLOOD_WHOLE).select(*on), "large", compact=True)
    alone = large.isEmpty()
    small = px if alone else px.join(large, on, "left_anti")

    def run(batches):
        for t in batches:
            found = [flooded(np.asarray(e, int), np.asarray(d, float), np.asarray(m, float), width) for e, d, m in zip(t["e"], t["distance"], t["marker"])]
            x = raster.spread(t, list(map(len, found)), e=list(t["e"]), marker=found)
            yield x.assign(marker=x["marker"].astype("Int32"))

    out = raster.gathered(small, *on, e="e", distance="distance", marker="marker").mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, e long, marker int")
    return out if alone else out.unionByName(_flood_rounds(px.join(large, on, "left_semi"), width))


def _flood_rounds(pixels: DataFrame, width: int) -> DataFrame:
    """``flood`` of sets of any size, in rounds over all edges."""
    spark, on = pixels.sparkSession, ["case_id", "set_id"]
    with Scratch(spark) as made:
        px = materialize(pixels.select(*on, "e", "distance", "marker"), "pixels")
        other = px.select(*on, F.col("e").alias("b"), F.col("distance").alias("d2"), F.col("marker").isNotNull().alias("rb"))
        step = F.explode(F.array(F.when(F.col("e") % width < width - 1, F.col("e") + 1), F.col("e") + width))
        edges = px.select(*on, F.col("e").alias("a"), "distance", F.col("marker").isNotNull().alias("ra"), step.alias("b")).where("b IS NOT NULL").join(other, [*on, "b"])
        way = F.struct((-F.least("distance", "d2")).alias("crest"), F.col("a").alias("lo"), F.col("b").alias("hi"))
        edges = materialize(edges.where("NOT (ra AND rb)").select(*on, "a", "b", "ra", "rb", way.alias("way")), "edges")
        moves: list[DataFrame] = []  # (fragment, where it goes), by round
        while True:
            ends = edges.select(*on, F.col("a").alias("f"), F.col("b").alias("o"), F.col("ra").alias("rf"), F.col("rb").alias("ro"), "way")
            ends = ends.unionByName(edges.select(*on, F.col("b").alias("f"), F.col("a").alias("o"), F.col("rb").alias("rf"), F.col("ra").alias("ro"), "way"))
            best = ends.where("NOT rf").groupBy(*on, "f").agg(F.min_by(F.struct("o", "ro"), "way").alias("m")).select(*on, "f", "m.o", "m.ro")
            best = materialize(best, "best", compact=True)
            if best.isEmpty():
                break
            # of two fragments that take the same edge the smaller one stays
            back = best.select(*on, F.col("f").alias("o"), F.col("o").alias("oo"))
            to = best.join(back, [*on, "o"], "left")
            stays = (F.col("oo") == F.col("f")) & (F.col("f") < F.col("o"))
            to = materialize(to.select(*on, "f", F.when(stays, F.col("f")).otherwise(F.col("o")).alias("t"), (F.col("ro") & ~F.coalesce(stays, F.lit(False))).alias("rooted")), "moves", compact=True)
            while True:  # chains by doubling
                after = to.select(*on, F.col("f").alias("t"), F.col("t").alias("t2"), F.col("rooted").alias("r2"))
                longer = to.join(after, [*on, "t"], "left").select(*on, "f", F.coalesce("t2", "t").alias("t"), F.coalesce("r2", "rooted").alias("rooted"), (F.coalesce("t2", "t") != F.col("t")).alias("moved"))
                longer = materialize(longer, "moves", compact=True)
                to = longer.drop("moved")
                if longer.where("moved").isEmpty():
                    break
            moves.append(to)
            for side, root in (("a", "ra"), ("b", "rb")):
                end = to.select(*on, F.col("f").alias(side), F.col("t").alias("_t"), F.col("rooted").alias("_r"))
                edges = edges.join(end, [*on, side], "left").withColumns({side: F.coalesce("_t", side), root: F.coalesce("_r", root)}).drop("_t", "_r")
            edges = edges.where("a <> b AND NOT (ra AND rb)").groupBy(*on, F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g"))
            edges = edges.agg(F.min("way").alias("way"), F.min_by("a", "way").alias("a"), F.min_by("ra", "way").alias("ra"), F.min_by("rb", "way").alias("rb"))
            edges = materialize(edges.select(*on, "a", F.when(F.col("a") == F.col("l"), F.col("g")).otherwise(F.col("l")).alias("b"), "ra", "rb", "way"), "edges")
        whole = None  # where a fragment of the first round ends
        for to in reversed(moves):
            to = to.select(*on, "f", "t")
            if whole is not None:
                later = whole.select(*on, F.col("f").alias("t"), F.col("t").alias("t2"))
                to = to.join(later, [*on, "t"], "left").select(*on, "f", F.coalesce("t2", "t").alias("t"))
                # fragments that first move in a later round
                to = to.unionByName(whole.join(to.select(*on, "f"), [*on, "f"], "left_anti"))
            whole = to
        seeds = px.where("marker IS NOT NULL").select(*on, F.col("e").alias("t"), "marker")
        at = px.select(*on, "e")
        at = at.withColumn("t", F.col("e")) if whole is None else at.join(whole.withColumnRenamed("f", "e"), [*on, "e"], "left").withColumn("t", F.coalesce("t", "e"))
        return made.keep(materialize(at.join(seeds, [*on, "t"], "left").select(*on, "e", "marker"), "basins"))


def _measured(regions: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys`` with area and half-open box (x0, y0, x1, y1)."""
    x, y = F.col("e") % width, F.floor(F.col("e") / width)
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))


def perimeters(regions: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """``keys`` with perimeter: elements with a neighbour (of eight) that isn't of the same region, the border's included."""
    own = regions.select(F.struct(*keys).alias("k"), "e")
    inner = raster.boundary(own.select(F.col("k").alias("case_id"), F.lit(0).alias("set_id"), "e"), width, height)
    return inner.groupBy("case_id").agg(F.count(F.lit(1)).alias("perimeter")).select("case_id.*", "perimeter")


#: Areas of bottleneck regions as shares of their root's, least contact with its outline, share of common boundary that joins.
SHAPE_AREAS, SHAPE_CONTACT, SHAPE_JOIN, SHAPE_MOST = (0.008, 0.62), 0.48, 0.26, 12


def basins(elem: DataFrame, width: int, height: int, join_share: float = SHAPE_JOIN, **peaks_of) -> DataFrame:
    """(case_id, set_id, region, e): sets of at least two peaks taken apart at their bottlenecks; basins whose common boundary is at least ``join_share``
    of the smaller perimeter are one, best first. ``peaks_of``: options of ``markers``."""
    px = materialize(markers(elem, width, height, **peaks_of), "peaks")
    several = px.groupBy("case_id", "set_id").agg(F.max("marker").alias("n")).where("n > 1").drop("n")
    px = materialize(flood(px.join(several, ["case_id", "set_id"]), width).where("marker IS NOT NULL"), "basins")
    # one case for the merges is a set of an image
    kinds = dict(px.dtypes)
    one = F.to_json(F.struct("case_id", "set_id"))
    labels = px.select(one.alias("case_id"), F.col("marker").alias("set_id"), "e")
    around = perimeters(labels.withColumnRenamed("set_id", "region"), ["case_id", "region"], width, height)
    joined = raster.merge_regions(around, raster.adjacency(labels, width), join_share)
    back = F.from_json("case_id", f"case_id {kinds['case_id']}, set_id {kinds['set_id']}")
    joined = joined.select(back.alias("of"), F.col("region").alias("marker"), F.col("merged").alias("region")).select("of.*", "marker", "region")
    return materialize(px.join(joined, ["case_id", "set_id", "marker"]).select("case_id", "set_id", "region", "e"), "regions")


def _regions_of(mask: np.ndarray, distance: np.ndarray, visuals: list[tuple[int, np.ndarray]], join_share: float, spacing: float, most: int) -> list[tuple]:
    """``shape_regions`` of one set: rows (region, area, fraction, contact, score, rank). visuals: size and mask of each."""
    ys, xs = np.nonzero(mask)
    whole, (height, width) = len(ys), mask.shape
    distance = np.where(np.isfinite(distance), distance, float(max(width, height)))
    y0, x0 = max(0, int(ys.min()) - 1), max(0, int(xs.min()) - 1)
    box = distance[y0 : ys.max() + 2, x0 : xs.max() + 2]
    found = peaks(box, max(4, round(whole**0.5 * spacing)), max(2.0, 0.035 * float(box.max())), most)
    if len(found) < 2:
        return []
    number = np.full(mask.shape, np.nan)
    for k, (y, x) in enumerate(found, 1):
        number[y + y0, x + x0] = k
    marker = flooded(ys * width + xs, distance[ys, xs], number[ys, xs], width)
    at = np.zeros(mask.shape, int)
    at[ys, xs] = np.where(np.isnan(marker), 0, marker)

    def edges(a: np.ndarray) -> np.ndarray:
        """Pixels with a neighbour of eight that isn't of the same region, the border's included."""
        wide = np.pad(a, 1, constant_values=-1)
        return (a > 0) & ~np.logical_and.reduce([wide[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] == a for dy in (-1, 0, 1) for dx in (-1, 0, 1)])

    names = np.unique(at[at > 0]).tolist()
    size = dict(zip(names, np.bincount(at[edges(at)], minlength=names[-1] + 1)[names].tolist()))
    near: dict = {k: {} for k in names}
    for p, q in ((at[:, :-1], at[:, 1:]), (at[:-1], at[1:])):
        met = (p > 0) & (q > 0) & (p != q)
        for a, b in zip(p[met].tolist(), q[met].tolist()):
            near[a][b] = near[b][a] = near[a].get(b, 0) + 1
    group = raster.joined_regions(size, near, join_share)
    to = np.arange(names[-1] + 1)
    to[names] = [group[k] for k in names]
    at = to[at]
    area = np.bincount(at.ravel())
    line = edges(at)
    outer = raster.grown((mask & ~raster.shrunk(mask[None], 1)[0])[None], 1)[0]
    around, touching = np.bincount(at[line], minlength=len(area)), np.bincount(at[line & outer], minlength=len(area))
    held = [(n, np.bincount(at[v & mask], minlength=len(area))) for n, v in visuals if n >= 16 and (v & mask).sum() / n >= 0.80 and 0.002 <= n / whole <= 0.55]
    rows = []
    for k in sorted(set(group.values())):
        contact, fraction = int(touching[k]) / int(around[k]), int(area[k]) / whole
        if not (SHAPE_AREAS[0] <= fraction <= SHAPE_AREAS[1] and contact >= SHAPE_CONTACT) or any(both[k] / area[k] >= 0.08 and both[k] / n >= 0.75 for n, both in held):
            continue
        # fixed values: the numbers
        rows.append((k, int(area[k]), fraction, contact, min(max(0.48 + 0.38 * contact + 0.08 * min(1.0, fraction / 0.12), 0.0), 0.94)))
    rows.sort(key=lambda r: (-r[4], -r[1], r[0]))
    return [(*r, k) for k, r in enumerate(rows[:SHAPE_MOST], 1)]


def shape_regions(elem: DataFrame, width: int, height: int, visual: DataFrame | None = None, **options) -> DataFrame:
    """Appendages and lobes of sets: (case_id, set_id, region, area, fraction, contact, score, rank), the best SHAPE_MOST of each set.

    A region counts if its share of the set and the share of its boundary that lies on the set's outline are in bounds,
    and no visual proposal covers it: visual (case_id, set_id, visual, e) lists those of each set. Regions of a set don't
    overlap, so none repeats another. Equal scores and areas go by region. Elements: ``basins`` with the same options.
    An image's sets of at most FLOOD_WHOLE elements meet their proposals as one row and are taken apart by one kernel.
    """
    on = ["case_id", "set_id"]
    root = elem.select(*on, "e").distinct()
    large = materialize(root.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FLOOD_WHOLE).select(*on), "large", compact=True)
    if large.isEmpty():
        return _whole_regions(root, width, height, visual, **options)
    some = _large_regions(root.join(large, on, "left_semi"), width, height, visual, **options)
    return _whole_regions(root.join(large, on, "left_anti"), width, height, visual, **options).unionByName(some)


def _whole_regions(root: DataFrame, width: int, height: int, visual: DataFrame | None, join_share: float = SHAPE_JOIN, least_area: int = 64, spacing: float = 0.04, most: int = 14) -> DataFrame:
    kinds = dict(root.dtypes)
    tables = {"root": raster.gathered(root, "case_id", "set_id", e="e")}
    seeing = visual is not None
    if seeing:
        tables["seen"] = raster.gathered(visual.select("case_id", "set_id", "visual", "e").distinct(), "case_id", "set_id", "visual", e="e")
    rows = raster.together(**tables).where("root IS NOT NULL")
    at_once = max(1, raster.AT_ONCE // (width * height))

    def run(batches):
        for t in batches:
            sets = [(case, s["set_id"], s["e"], seen) for case, own, seen in zip(t["case_id"], t["root"], t["seen"] if seeing else [None] * len(t)) for s in own if len(s["e"]) >= least_area]
            out = []
            for k in range(0, len(sets), at_once):
                part = sets[k : k + at_once]
                masks = raster.masks_of(pd.Series([s[2] for s in part]), width, height)
                square = raster.squared_distances(masks)
                distance = np.where(square >= raster._FAR, np.inf, np.sqrt(square))
                for (case, name, _, seen), m, d in zip(part, masks, distance):
                    of = [] if seen is None else [v["e"] for v in seen if v["set_id"] == name]
                    visuals = list(zip(map(len, of), raster.masks_of(pd.Series(of), width, height))) if of else []
                    out += [(case, name, *r) for r in _regions_of(m, d, visuals, join_share, spacing, most)]
            yield pd.DataFrame(out, columns=["case_id", "set_id", "region", "area", "fraction", "contact", "score", "rank"])

    return rows.mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, region int, area long, fraction double, contact double, score double, rank int")


def _large_regions(root: DataFrame, width: int, height: int, visual: DataFrame | None, **options) -> DataFrame:
    """``shape_regions`` of sets of any size, by joins of their elements."""
    on = ["case_id", "set_id"]
    parts = basins(root, width, height, **options)
    areas = parts.groupBy(*on, "region").agg(F.count(F.lit(1)).alias("area"))
    whole = root.groupBy(*on).agg(F.count(F.lit(1)).alias("whole"))
    outline = raster.dilate(raster.boundary(root, width, height), width, height)
    own = parts.select(F.struct(*on, "region").alias("case_id"), F.lit(0).alias("set_id"), "e")
    edge = raster.boundary(own, width, height).select("case_id.*", "e").join(outline.withColumn("outer", F.lit(1)).hint("merge"), [*on, "e"], "left")
    contact = edge.groupBy(*on, "region").agg(F.avg(F.coalesce("outer", F.lit(0)).cast("double")).alias("contact"))
    x = areas.join(whole, on).join(contact, [*on, "region"]).withColumn("fraction", F.col("area") / F.col("whole"))
    x = x.where(F.col("fraction").between(*SHAPE_AREAS) & (F.col("contact") >= SHAPE_CONTACT))
    # fixed values: the numbers
    score = F.least(F.greatest(0.48 + 0.38 * F.col("contact") + 0.08 * F.least(F.lit(1.0), F.col("fraction") / 0.12), F.lit(0.0)), F.lit(0.94))
    x = x.withColumn("score", score)
    if visual is not None:
        seen = visual.select(*on, "visual", "e").distinct()
        size = seen.groupBy(*on, "visual").agg(F.count(F.lit(1)).alias("seen"))
        held = seen.hint("merge").join(root, [*on, "e"]).groupBy(*on, "visual").agg(F.count(F.lit(1)).alias("held"))
        usable = size.join(held, [*on, "visual"]).join(whole, on).where((F.col("seen") >= 16) & (F.col("held") / F.col("seen") >= 0.80) & (F.col("seen") / F.col("whole")).between(0.002, 0.55))
        both = seen.hint("merge").join(parts, [*on, "e"]).groupBy(*on, "visual", "region").agg(F.count(F.lit(1)).alias("both"))
        covered = both.join(usable, [*on, "visual"]).join(areas, [*on, "region"]).where((F.col("both") / F.col("area") >= 0.08) & (F.col("both") / F.col("seen") >= 0.75))
        x = x.join(covered.select(*on, "region").distinct(), [*on, "region"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("score"), F.desc("area"), "region"))
    return x.withColumn("rank", rank).where(F.col("rank") <= SHAPE_MOST).select(*on, "region", "area", "fraction", "contact", "score", "rank")


# -- surfaces and faces --


def _surfaces_of(owner: np.ndarray, names: np.ndarray, tones: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring regions of images and their measures, as columns; ``image`` is the number of the map.

    owner: (images, h, w) places in ``names``, -1 outside; tones: (3, images, h, w), nan where there is none; seeds:
    image, number (rising with the image) and pixel of each of their elements.
    """
    n, h, w = owner.shape
    key, at = np.unique(np.where(owner >= 0, owner + np.arange(n)[:, None, None] * len(names), -1), return_inverse=True)
    if not len(key) or key[-1] < 0:
        return {}
    at = at.reshape(owner.shape)
    if key[0] < 0:
        key, at = key[1:], at - 1
    image, code = np.divmod(key, len(names))
    k, y, x = np.nonzero(at >= 0)
    own = at[k, y, x]
    out = {"area": np.bincount(own, minlength=len(key))}
    for c, v in (("x", x), ("y", y)):
        for name, of, start, add in ((f"{c}0", np.minimum, max(h, w), 0), (f"{c}1", np.maximum, -1, 1)):
            ends = np.full(len(key), start)
            of.at(ends, own, v)
            out[name] = ends + add
    wide = np.pad(at, ((0, 0), (1, 1), (1, 1)), constant_values=-2)
    inner = np.logical_and.reduce([wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] == at for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    out["perimeter"] = np.bincount(own[~inner[k, y, x]], minlength=len(key))
    toned = np.zeros(len(key), bool)
    for c, t in zip("lab", tones):
        v = t[k, y, x]
        there = ~np.isnan(v)
        order = np.lexsort((v[there], own[there]))
        v, many = v[there][order], np.bincount(own[there], minlength=len(key))
        toned |= many > 0
        begin = np.cumsum(many) - many
        pick = lambda j: v[np.minimum(begin + j, max(0, len(v) - 1))] if len(v) else np.zeros(len(key))
        out[c] = np.where(many > 0, 0.5 * pick(np.maximum(many - 1, 0) // 2) + 0.5 * pick(many // 2), np.nan)
    total = np.bincount(image[toned], out["area"][toned], minlength=n).astype(np.int64)
    touch = []
    for p, q in ((at[:, :, :-1], at[:, :, 1:]), (at[:, :-1], at[:, 1:])):
        met = (p >= 0) & (q >= 0) & (p != q)
        touch.append(np.stack([np.minimum(p[met], q[met]), np.maximum(p[met], q[met])]))
    left, right, contact = raster.counted(*np.concatenate(touch, axis=1))
    ok = toned[left] & toned[right]
    left, right, contact = left[ok], right[ok], contact[ok]
    found = {"image": image[left], "left": names[code[left]], "right": names[code[right]], "contact": contact, "total": total[image[left]]}
    first = out["area"][left] <= out["area"][right]
    s, g = np.where(first, left, right), np.where(first, right, left)
    found |= {"smaller": names[code[s]], "larger": names[code[g]]}
    found |= {f"{side}_{c}": v[i] for side, i in (("s", s), ("g", g)) for c, v in out.items()}
    # of the envelopes that hold something of both the one with the best support, then precision
    support, precision = np.zeros(len(left)), np.zeros(len(left))
    of, seed, e = seeds
    if len(seed) and len(left):
        size, hit = np.bincount(seed), at.reshape(n, -1)[of, e]
        hits, many = np.unique(seed[hit >= 0] * len(key) + hit[hit >= 0], return_counts=True)
        first = np.full(len(size), n)
        np.minimum.at(first, seed, of)
        begin, end = np.searchsorted(first, image[left]), np.searchsorted(first, image[left], side="right")
        pair = np.repeat(np.arange(len(left)), end - begin)
        each = np.arange(len(pair)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[pair]

        def held(region: np.ndarray) -> np.ndarray:
            j = np.minimum(np.searchsorted(hits, each * len(key) + region), max(0, len(hits) - 1))
            return np.where(hits[j] == each * len(key) + region, many[j], 0) if len(hits) else np.zeros(len(region), int)

        m, o = held(left[pair]), held(right[pair])
        both = (m > 0) & (o > 0)
        pair, m, o, each = pair[both], m[both], o[both], each[both]
        s, q = np.minimum(m / out["area"][left[pair]], o / out["area"][right[pair]]), (m + o) / size[each]
        order = np.lexsort((q, s, pair))
        support[pair[order]], precision[pair[order]] = s[order], q[order]  # the last of a pair stays
    return found | {"support": support, "precision": precision}


def surface_pairs(regions: DataFrame, colours: DataFrame, width: int, height: int, seeds: DataFrame | None = None) -> DataFrame:
    """Neighbouring regions of a case and what speaks for joining them: (case_id, a, b, smaller, larger, contact, contact_ratio, lab_distance,
    merged_fraction, horizontal_overlap, vertical_overlap, area_ratio, aspect_ratio, upper, support, precision).

    regions: exclusive map (case_id, region, e); colours: (case_id, e, l, a, b); seeds: envelopes (case_id, seed, e).
    Medians are exact. An image's map, colours and envelopes meet as one row, and only its pairs leave the kernel.
    """
    kinds = dict(regions.dtypes)
    tables = {"own": regions.select("case_id", "region", "e"), "tone": colours.select("case_id", "e", *(F.col(c).cast("double") for c in "lab"))}
    seeded = seeds is not None
    if seeded:
        tables["seeds"] = seeds.select("case_id", "seed", "e").distinct()
    rows = None
    for name, t in tables.items():
        one = raster.gathered(t, "case_id", **{f"{name}_{c}": c for c in t.columns if c != "case_id"})
        rows = one if rows is None else rows.hint("merge").join(one, "case_id", "left")
    stats = [("area", "long"), *((f"{c}{k}", "long") for k in (0, 1) for c in "xy"), ("perimeter", "long"), *((c, "double") for c in "lab")]
    columns = {**{c: kinds["region"] for c in ("left", "right", "smaller", "larger")}, "contact": "long", "total": "long", **{f"{s}_{c}": k for s in "sg" for c, k in stats}, "support": "double", "precision": "double"}

    def run(batches):
        for t in batches:
            for part in raster._runs_of(t, width * height):
                names, owner = raster.maps_of(part["own_region"], part["own_e"], width, height)
                tones = np.full((3, len(part), height * width), np.nan)
                of, number, at, before = [], [], [], 0
                for k in range(len(part)):
                    r = part.iloc[k]
                    if r["tone_e"] is not None:
                        e = np.asarray(r["tone_e"], int)
                        for c, grid in zip("lab", tones):
                            grid[k, e] = r[f"tone_{c}"]
                    if seeded and r["seeds_e"] is not None:
                        own, place = np.unique(np.asarray(r["seeds_seed"]), return_inverse=True)
                        at.append(np.asarray(r["seeds_e"], int))
                        number.append(place + before)
                        of.append(np.full(len(place), k))
                        before += len(own)
                empty = [np.zeros(0, int)]
                found = _surfaces_of(owner, names, tones.reshape(3, *owner.shape), tuple(np.concatenate(v or empty) for v in (of, number, at)))
                if found:
                    yield pd.DataFrame({"case_id": part["case_id"].to_numpy()[found["image"]]} | {c: found[c] for c in columns})

    x = rows.mapInPandas(run, f"case_id {kinds['case_id']}, " + ", ".join(f"{c} {k}" for c, k in columns.items()))
    x = materialize(x, "surfaces", compact=True)
    span = lambda r, k: F.col(f"{r}_{k}1") - F.col(f"{r}_{k}0")
    shared = lambda k: F.greatest(F.lit(0), F.least(F.col(f"s_{k}1"), F.col(f"g_{k}1")) - F.greatest(F.col(f"s_{k}0"), F.col(f"g_{k}0")))
    x = x.select(
        "case_id", F.col("left").alias("a"), F.col("right").alias("b"), "smaller", "larger", "contact",
        (F.col("contact") / F.greatest(F.lit(1), F.least("s_perimeter", "g_perimeter"))).alias("contact_ratio"),
        F.sqrt(sum(((F.col(f"s_{c}") - F.col(f"g_{c}")) ** 2 for c in "lab"), F.lit(0.0))).alias("lab_distance"),
        ((F.col("s_area") + F.col("g_area")) / F.col("total")).alias("merged_fraction"),
        (shared("x") / F.least(span("s", "x"), span("g", "x"))).alias("horizontal_overlap"),
        (shared("y") / span("s", "y")).alias("vertical_overlap"),
        (F.col("s_area") / F.col("g_area")).alias("area_ratio"),
        (span("s", "x") / span("s", "y")).alias("aspect_ratio"),
        ((0.5 * (F.col("s_y0") + F.col("s_y1")) <= F.col("g_y0") + 0.68 * span("g", "y")) & (F.col("g_y1") >= F.col("s_y1") + 0.15 * span("g", "y"))).alias("upper"),
        "support", "precision",
    )
    return x


def _within(**limits: tuple[float | None, float | None]) -> Column:
    out = F.lit(True)
    for name, (low, high) in limits.items():
        out = out & (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
    return out


def surface_reason(pairs: DataFrame) -> DataFrame:
    """``pairs`` with why two surfaces are one: "appearance_continuity", "shared_envelope_structural_face" or null. The limits."""
    alike = _within(merged_fraction=(None, 0.10)) & (_within(contact_ratio=(0.40, None), lab_distance=(None, 76.0)) | _within(contact_ratio=(0.58, None), lab_distance=(None, 96.0)))
    face = F.col("upper") & _within(merged_fraction=(None, 0.13), contact_ratio=(0.06, None), horizontal_overlap=(0.82, None), area_ratio=(None, 0.68), lab_distance=(None, 100.0), support=(0.72, None), precision=(0.52, None))
    return pairs.withColumn("reason", ladder([("appearance_continuity", alike), ("shared_envelope_structural_face", face)], None))


def face_reason(pairs: DataFrame, seeded: bool) -> DataFrame:
    """``pairs`` with reason (which kind of projected face the smaller region is of the larger, or null) and accepted.

    A pair with a reason isn't accepted if its larger region is itself a face of another, nor if a better pair has the
    same smaller region: by contact, vertical and horizontal overlap, then nearness of colour; ties go to the longer
    contact, then to the smaller names. Where there are seeds, faces of more than 0.125 of the object need an envelope.
    Fixed values: the limits.
    """
    upper = F.col("upper")
    kinds = [
        ("projected_face", upper & _within(merged_fraction=(None, 0.13), contact_ratio=(0.06, None), horizontal_overlap=(0.82, None), vertical_overlap=(0.55, None), area_ratio=(None, 0.68), aspect_ratio=(1.30, None), lab_distance=(None, 100.0))),
        ("strong_projected_face", upper & _within(merged_fraction=(None, 0.24), contact_ratio=(0.28, None), horizontal_overlap=(0.80, None), vertical_overlap=(0.55, None), area_ratio=(None, 0.50), aspect_ratio=(1.30, None), lab_distance=(None, 150.0))),
        ("compact_projected_face", upper & _within(merged_fraction=(None, 0.08), contact_ratio=(0.30, None), horizontal_overlap=(0.58, None), vertical_overlap=(0.55, None), area_ratio=(None, 0.68), aspect_ratio=(1.20, None), lab_distance=(None, 150.0))),
    ]
    evidence = _within(merged_fraction=(None, 0.125)) | _within(support=(0.72, None), precision=(0.52, None)) if seeded else F.lit(True)
    x = pairs.withColumn("reason", ladder(kinds, None)).withColumn("_open", F.col("reason").isNotNull() & evidence)
    # a region's neighbours are few; all of them meet by its name
    chained = x.where("_open").select("case_id", F.col("smaller").alias("larger")).distinct().withColumn("_chain", F.lit(True))
    order = [F.desc(c) for c in ("contact_ratio", "vertical_overlap", "horizontal_overlap")] + [F.asc("lab_distance"), F.desc("contact"), F.asc("a"), F.asc("b")]
    place = F.row_number().over(Window.partitionBy("case_id", "smaller", "_open").orderBy(*order))
    x = x.withColumn("_place", place).join(chained, ["case_id", "larger"], "left")
    accepted = F.col("_open") & F.col("_chain").isNull() & (F.col("_place") == 1)
    return x.withColumn("accepted", accepted).drop("_open", "_place", "_chain")


def merged(regions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(case_id, region, merged): regions with the smallest one that accepted pairs (case_id, a, b) join them to."""
    node = lambda c: F.struct("case_id", F.col(c).alias("region"))
    groups = graph.connected_components(accepted.select(node("a").alias("a"), node("b").alias("b")))
    groups = groups.select("id.*", F.col("component.region").alias("merged"))
    names = regions.select("case_id", "region").distinct()
    return names.join(groups, ["case_id", "region"], "left").withColumn("merged", F.coalesce("merged", "region"))
