"""Value rasters in square tiles, stencils that cross their borders, and how well outlines follow the edges of an image.

A tile row is (case_id, ty, tx, values): channels one after another, each row by row, as far as the image reaches. A
stencil gets each tile with a margin: neighbours send the strips that lie in it, so a pixel is copied once for each
tile that it borders on and not once for each neighbour, and no task holds an image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

TILE = 64


def to_tiles(pixels: DataFrame, channels: list[str], width: int, height: int, size: int = TILE) -> DataFrame:
    """Tiles of pixels (case_id, e, channels...), of which each image has all; at most ``size`` squared pixels meet."""
    x, y = F.col("e") % width, F.floor(F.col("e") / width)
    p = pixels.select("case_id", F.floor(y / size).cast("int").alias("ty"), F.floor(x / size).cast("int").alias("tx"), F.struct("e", *(F.col(c).cast("float").alias(c) for c in channels)).alias("p"))
    p = p.groupBy("case_id", "ty", "tx").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return p.select("case_id", "ty", "tx", F.concat(*(F.col(f"p.{c}") for c in channels)).alias("values"))


def mirrored(k: np.ndarray, n: int) -> np.ndarray:
    """Places inside 0 to n - 1 of those mirrored about the outermost ones."""
    k = np.abs(k) % max(1, 2 * (n - 1))
    return np.where(k >= n, 2 * (n - 1) - k, k)


def stencil(tiles: DataFrame, of: Callable[[np.ndarray], np.ndarray], margin: int, channels: int, width: int, height: int, size: int = TILE) -> DataFrame:
    """Tiles of ``of``, which takes an array (channels, h + 2 * margin, w + 2 * margin) and gives (channels', h, w).

    The margin is at most the tile's size. Beyond the image's border pixels are mirrored about the outermost one.
    """
    kinds = dict(tiles.dtypes)

    def box(ty: int, tx: int) -> tuple[int, int, int, int]:
        return ty * size, min(height, (ty + 1) * size), tx * size, min(width, (tx + 1) * size)

    def send(batches):
        for t in batches:
            out = []
            for case, ty, tx, v in zip(t["case_id"].to_numpy(dtype=object), t["ty"], t["tx"], t["values"]):
                y0, y1, x0, x1 = box(ty, tx)
                a = np.asarray(v, np.float32).reshape(channels, y1 - y0, x1 - x0)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if not (0 <= (ty + dy) * size < height and 0 <= (tx + dx) * size < width):
                            continue
                        v0, v1, u0, u1 = box(ty + dy, tx + dx)
                        r0, r1, c0, c1 = max(y0, v0 - margin), min(y1, v1 + margin), max(x0, u0 - margin), min(x1, u1 + margin)
                        if r0 < r1 and c0 < c1:
                            out.append((case, ty + dy, tx + dx, r0, c0, r1 - r0, a[:, r0 - y0 : r1 - y0, c0 - x0 : c1 - x0].ravel()))
            yield pd.DataFrame(out, columns=["case_id", "ty", "tx", "y", "x", "rows", "values"])

    def one(ty: int, tx: int, strips) -> np.ndarray:
        y0, y1, x0, x1 = box(ty, tx)
        top, left = y0 - margin, x0 - margin
        a = np.zeros((channels, y1 - y0 + 2 * margin, x1 - x0 + 2 * margin), np.float32)
        for s in strips:
            y, x, rows = s["y"], s["x"], s["rows"]
            part = np.asarray(s["values"], np.float32).reshape(channels, rows, -1)
            a[:, y - top : y - top + rows, x - left : x - left + part.shape[2]] = part
        a = a[:, mirrored(np.arange(top, y1 + margin), height) - top][:, :, mirrored(np.arange(left, x1 + margin), width) - left]
        return of(a).astype(np.float32).ravel()

    def run(batches):
        for t in batches:
            yield t[["case_id", "ty", "tx"]].assign(values=[one(ty, tx, s) for ty, tx, s in zip(t["ty"], t["tx"], t["strips"])])

    strips = tiles.select("case_id", "ty", "tx", "values").mapInPandas(send, f"case_id {kinds['case_id']}, ty int, tx int, y int, x int, rows int, values array<float>")
    strips = strips.groupBy("case_id", "ty", "tx").agg(F.collect_list(F.struct("y", "x", "rows", "values")).alias("strips"))
    return strips.mapInPandas(run, f"case_id {kinds['case_id']}, ty int, tx int, values array<float>")


def to_pixels(tiles: DataFrame, width: int, size: int = TILE, name: str = "value") -> DataFrame:
    """(case_id, e, value) of tiles of one channel."""
    p = tiles.select("case_id", "ty", "tx", F.posexplode("values").alias("k", name))
    w = F.least(F.lit(width) - F.col("tx") * size, F.lit(size))
    return p.select("case_id", ((F.col("ty") * size + F.floor(F.col("k") / w)) * width + F.col("tx") * size + F.col("k") % w).cast("long").alias("e"), name)


def gradients(sigma: float = 0.65) -> Callable[[np.ndarray], np.ndarray]:
    """Greatest gradient of any channel of arrays (..., channels, h + 6, w + 6), after a Gaussian blur of five pixels (fixed values: its width, the Sobel weights)."""
    at = np.arange(-2, 3)
    kernel = np.exp(-(at**2) / (2 * sigma * sigma))
    kernel /= kernel.sum()

    def along(a: np.ndarray, weights, axis: int) -> np.ndarray:
        n = a.shape[axis] - len(weights) + 1
        part = lambda k: a[..., k : k + n] if axis == -1 else a[..., k : k + n, :]
        return sum(w * part(k) for k, w in enumerate(weights))

    def of(a: np.ndarray) -> np.ndarray:
        a = along(along(a.astype(np.float64), kernel, -2), kernel, -1)
        dx, dy = along(along(a, (-1, 0, 1), -1), (1, 2, 1), -2), along(along(a, (-1, 0, 1), -2), (1, 2, 1), -1)
        return np.hypot(dx, dy).max(axis=-3, keepdims=True)

    return of


def edge_strength(tiles: DataFrame, channels: int, width: int, height: int, size: int = TILE, sigma: float = 0.65) -> DataFrame:
    """Tiles of ``gradients``."""
    return stencil(tiles, gradients(sigma), 3, channels, width, height, size)


def outlines(elem: DataFrame, width: int, height: int) -> DataFrame:
    """(case_id, set_id, e) of the pixels in whose square of nine are both elements and others; beyond the border is neither."""
    d = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    p = elem.select("case_id", "set_id", "e").distinct().withColumns({"x": F.col("e") % width, "y": F.floor(F.col("e") / width), "dx": F.explode(d)}).withColumn("dy", F.explode(d))
    p = p.select("case_id", "set_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    p = p.groupBy("case_id", "set_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    across = lambda c, n: F.lit(1) + (F.col(c) > 0).cast("int") + (F.col(c) < n - 1).cast("int")
    return p.where(F.col("n") < across("x", width) * across("y", height)).select("case_id", "set_id", (F.col("y") * width + F.col("x")).cast("long").alias("e"))


def boundary_alignment(strength: DataFrame, elem: DataFrame, width: int, height: int) -> DataFrame:
    """(case_id, set_id, alignment): mean edge strength on a set's outline, as a share (1 at most) of the image's 0.9 quantile.

    strength: (case_id, e, value). A set without an outline, or in an image without edges, has 0.
    """
    top = strength.groupBy("case_id").agg(F.percentile("value", F.lit(0.9)).alias("top"))
    mean = outlines(elem, width, height).hint("merge").join(strength, ["case_id", "e"]).groupBy("case_id", "set_id").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    x = elem.select("case_id", "set_id").distinct().join(mean, ["case_id", "set_id"], "left").join(top, "case_id", "left")
    share = F.when((F.col("top") > 1e-6) & F.col("mean").isNotNull(), F.least(F.col("mean") / F.col("top"), F.lit(1.0)))
    return x.select("case_id", "set_id", F.coalesce(share, F.lit(0.0)).alias("alignment"))


def image_alignment(images: DataFrame, elem: DataFrame, channels: int, width: int, height: int) -> DataFrame:
    """``boundary_alignment`` of images that are one tile each, (case_id, values), by a kernel of many images at a time.

    An image meets its sets as one row and neither pixels nor strengths are shuffled; larger images are for ``edge_strength``.
    """
    kinds, of = dict(elem.dtypes), gradients()
    sets = raster.gathered(raster.gathered(elem.select("case_id", "set_id", "e"), "case_id", "set_id", e="e"), "case_id", set_id="set_id", e="e")
    rows = sets.hint("merge").join(images.select("case_id", "values"), "case_id", "left")
    pixels, place = width * height, 0.9 * (width * height - 1)

    def run(batches):
        ys, xs = mirrored(np.arange(-3, height + 3), height), mirrored(np.arange(-3, width + 3), width)
        for t in batches:
            for part in raster._runs_of(t, 4 * channels * pixels):
                there = part["values"].notna().to_numpy()
                strength, top = np.zeros((len(part), pixels)), np.zeros(len(part))
                if there.any():
                    a = np.stack([np.asarray(v, np.float32) for v in part["values"][there]]).reshape(-1, channels, height, width)
                    strength[there] = of(a[:, :, ys][:, :, :, xs]).astype(np.float32).reshape(len(a), pixels)
                    low = np.sort(strength, axis=1)
                    lo, hi = low[:, int(place)], low[:, min(pixels - 1, int(place) + 1)]
                    top = lo + (place - int(place)) * (hi - lo)
                k = np.repeat(np.arange(len(part)), part["set_id"].map(len).to_numpy())
                m = raster.masks_of(pd.Series([e for row in part["e"] for e in row]), width, height)
                line = (raster.grown(m, 1) & raster.grown(~m, 1)).reshape(len(m), pixels)
                mean = (strength[k] * line).sum(1) / np.maximum(1, line.sum(1))
                share = np.where(top[k] > 1e-6, np.minimum(mean / np.maximum(top[k], 1e-6), 1.0), 0.0)
                yield pd.DataFrame({"case_id": part["case_id"].to_numpy()[k], "set_id": np.concatenate([np.asarray(s) for s in part["set_id"]]), "alignment": share})

    return rows.mapInPandas(run, f"case_id {kinds['case_id']}, set_id {kinds['set_id']}, alignment double")
