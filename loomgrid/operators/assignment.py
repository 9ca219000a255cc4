"""Optimal assignment and what is evaluated with it. Cases of few pairs are one Arrow batch each; larger ones are split into what their pairs connect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import two_digits
from ..storage import materialize, small
from .graph import connected_components
from .overlap import cross_overlap

#: The IoU thresholds of the evaluation.
THRESHOLDS = [round(0.25 + 0.05 * k, 2) for k in range(11)]


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost matching of all rows or all columns, whichever are fewer, by shortest augmenting paths."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in solve(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            r = match[j]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.flatnonzero(~used[1:]) + 1
            to = free[low[free].argmin()]
            d = low[to]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j = to
        while j:
            match[j], j = match[way[j]], way[j]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


#: Cases of more pairs are split into connected components.
LARGE = 10_000


def units(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with unit: rows of different units of a case share no member, so a case's best matching is that of its units together.

    A case of at most LARGE pairs is one unit; of a larger one, what its pairs connect is.
    """
    pairs = materialize(pairs, "pairs")
    large = pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("case_id")
    if large.isEmpty():
        return pairs.withColumn("unit", F.lit("").cast("string"))
    large = small(materialize(large, "large", compact=True), 100_000)
    split = pairs.join(large, "case_id", "left_semi")
    node = lambda side: F.struct("case_id", F.lit(side).alias("side"), F.col(side).cast("string").alias("member"))
    found = connected_components(split.select(node(left).alias("a"), node(right).alias("b")))
    found = found.where(F.col("id.side") == left).select("id.case_id", F.col("id.member").alias("_member"), F.concat("component.side", F.lit(":"), "component.member").alias("unit"))
    split = split.withColumn("_member", F.col(left).cast("string")).join(found, ["case_id", "_member"]).drop("_member")
    return split.unionByName(pairs.join(large, "case_id", "left_anti").withColumn("unit", F.lit("").cast("string")))


def assign(pairs: DataFrame, score: str, least: float = 0.0) -> DataFrame:
    """(case_id, a, b, score) of the one-to-one matching of greatest total score per case; pairs below ``least`` are
    left out afterwards. ``pairs`` holds the non-zero scores (case_id, a, b, score)."""
    kinds = dict(pairs.dtypes)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        (i, a), (j, b) = pd.factorize(t["a"], sort=True), pd.factorize(t["b"], sort=True)
        m = np.zeros((len(a), len(b)))
        m[i, j] = t[score]
        out = [(t["case_id"].iloc[0], a[i], b[j], m[i, j]) for i, j in solve(-m) if m[i, j] > 0 and m[i, j] >= least]
        return pd.DataFrame(out, columns=["case_id", "a", "b", score])

    return units(pairs.select("case_id", "a", "b", score), "a", "b").groupBy("case_id", "unit").applyInPandas(one, f"case_id {kinds['case_id']}, a {kinds['a']}, b {kinds['b']}, {score} double")


def threshold_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, threshold, precision, recall, f1) at IoU thresholds .25 to .75, from one matching per case."""
    sides = [x.select("case_id", "set_id").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((predicted, "np"), (truth, "nt"))]
    counts = sides[0].join(sides[1], "case_id", "full").na.fill(0, ["np", "nt"])
    m = assign(cross_overlap(predicted, truth), "iou")
    grid = counts.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    hits = grid.join(m, "case_id", "left").groupBy("case_id", "threshold", "np", "nt").agg(F.count_if(F.col("iou") >= F.col("threshold")).alias("tp"))
    p, r = F.col("tp") / F.greatest("np", F.lit(1)), F.col("tp") / F.greatest("nt", F.lit(1))
    return hits.select("case_id", "threshold", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))


def carry_ids(current: DataFrame, previous: DataFrame, pairs: DataFrame, least: float = 0.2) -> DataFrame:
    """``current`` (case_id, set_id) with ``part_id``: that of the matched previous set, else a new number after its scope's last.

    previous: (case_id, set_id, part_id of the form name-NN). pairs: (case_id, a of current, b of previous, score).
    """
    from pyspark.sql.window import Window

    m = assign(pairs, "score", least).join(previous.select("case_id", F.col("set_id").alias("b"), "part_id"), ["case_id", "b"]).select("case_id", F.col("a").alias("set_id"), "part_id")
    last = previous.groupBy("case_id").agg(F.max(F.regexp_extract("part_id", "-([0-9]+)$", 1).cast("int")).alias("last"))
    x = current.join(m, ["case_id", "set_id"], "left").join(last, "case_id", "left")
    new = F.row_number().over(Window.partitionBy("case_id", F.col("part_id").isNull()).orderBy("set_id"))
    number = F.coalesce("last", F.lit(0)) + new
    return x.withColumn("part_id", F.coalesce("part_id", F.concat(F.lit("part-"), two_digits(number)))).drop("last")


def assign_plans(pairs: DataFrame, plans: DataFrame, least: float) -> DataFrame:
    """(case_id, plan, region, score) of the matching of greatest total score in which every plan may stay alone.

    pairs: (case_id, plan, region, score); plans: (case_id, plan). Each plan has a place of its own that scores 0, so
    a bad pair is never forced; of the chosen pairs those below ``least`` are left out. Plans without a region have nulls.
    """
    kinds = dict(pairs.dtypes)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        (i, a), (j, b) = pd.factorize(t["plan"], sort=True), pd.factorize(t["region"], sort=True)
        m = np.zeros((len(a), len(b) + len(a)))
        m[i, j] = t["score"]
        # a plan's own place is closed to the others
        m[:, len(b) :] = -1e6 * (1 - np.eye(len(a)))
        out = [(t["case_id"].iloc[0], a[r], b[c], m[r, c]) for r, c in solve(-m) if c < len(b) and m[r, c] >= least]
        return pd.DataFrame(out, columns=["case_id", "plan", "region", "score"])

    got = units(pairs.select("case_id", "plan", "region", "score"), "plan", "region").groupBy("case_id", "unit").applyInPandas(one, f"case_id {kinds['case_id']}, plan {kinds['plan']}, region {kinds['region']}, score double")
    return plans.select("case_id", "plan").join(got, ["case_id", "plan"], "left")


def carry_scores(pairs: DataFrame, current: DataFrame, previous: DataFrame, diagonal: Column) -> DataFrame:
    """``pairs`` (case_id, a, b, iou) of sets of one name with score: .8 IoU + .2 exp(-4 distance / diagonal) (fixed values).

    current, previous: (case_id, set_id, name, cx, cy).
    """
    side = lambda x, s: x.select("case_id", F.col("set_id").alias(s), F.col("name").alias(f"{s}n"), F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"))
    all_ = side(current, "a").join(side(previous, "b"), "case_id").where("an = bn")
    x = all_.join(pairs.select("case_id", "a", "b", "iou"), ["case_id", "a", "b"], "left")
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return x.select("case_id", "a", "b", (0.8 * F.coalesce("iou", F.lit(0.0)) + 0.2 * F.exp(-4 * apart / F.greatest(diagonal, F.lit(1.0)))).alias("score"))


def layer_scores(truth: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """``threshold_scores`` of several prediction layers (parts, groups), with their name as ``layer``."""
    out = None
    for name, rows in layers.items():
        one = threshold_scores(rows, truth).withColumn("layer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def semantic_threshold_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``threshold_scores`` where a pair only matches under one name (case_id, set_id, name, e); unnamed predictions count in the precision."""
    pair = lambda x: x.select(F.struct("case_id", "name").alias("case_id"), "set_id", "e")
    m = assign(cross_overlap(pair(predicted.where("name IS NOT NULL")), pair(truth)), "iou").select("case_id.case_id", "iou")
    sides = [x.select("case_id", "set_id").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((predicted, "np"), (truth, "nt"))]
    counts = sides[0].join(sides[1], "case_id", "full").na.fill(0, ["np", "nt"]).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    hits = counts.join(m, "case_id", "left").groupBy("case_id", "threshold", "np", "nt").agg(F.count_if(F.col("iou") >= F.col("threshold")).alias("tp"))
    p, r = F.col("tp") / F.greatest("np", F.lit(1)), F.col("tp") / F.greatest("nt", F.lit(1))
    return hits.select("case_id", "threshold", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))


def component_scores(predicted: DataFrame, truth: DataFrame, width: int, height: int, least_iou: float = 0.25, least_area: int = 12, small: float = 0.01) -> DataFrame:
    """(case_id, precision, recall, f1, small_recall, count_error) of the four-connected components of label maps (case_id, e, label).

    Components of one label match one to one by IoU. small_recall is over true components of at most ``small`` of the
    foreground, 1 without any; count_error sums the labels' differences in number. Labels that the truth lacks don't
    count; components below ``least_area`` don't either.
    """
    from .raster import components

    known = truth.select("case_id", "label").distinct()
    parts = lambda x: components(x.select("case_id", F.col("label").alias("set_id"), "e"), width, height, False, least_area).select(F.struct("case_id", F.col("set_id").alias("label")).alias("case_id"), F.col("component").alias("set_id"), "e")
    p, t = parts(predicted.join(known, ["case_id", "label"], "left_semi")), parts(truth)
    m = assign(cross_overlap(p, t), "iou").where(F.col("iou") >= least_iou)
    size = t.groupBy("case_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    front = truth.groupBy("case_id").agg(F.count(F.lit(1)).alias("front"))
    s = size.join(m.select("case_id", F.col("b").alias("set_id"), F.lit(1).alias("hit")), ["case_id", "set_id"], "left")
    s = s.select("case_id.case_id", "case_id.label", "n", "hit").join(front, "case_id").withColumn("is_small", F.col("n") / F.col("front") <= small)
    per = s.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("nt"), F.count("hit").alias("tp"), F.count_if("is_small").alias("ns"), F.count(F.when(F.col("is_small"), F.col("hit"))).alias("hs"))
    n = p.select("case_id.case_id", "case_id.label", "set_id").distinct().groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("np"))
    x = per.join(n, ["case_id", "label"], "full").na.fill(0, ["nt", "tp", "ns", "hs", "np"])
    g = x.groupBy("case_id").agg(*(F.sum(k).alias(k) for k in ("nt", "tp", "ns", "hs", "np")), F.sum(F.abs(F.col("np") - F.col("nt"))).alias("count_error"))
    a, b = F.col("tp") / F.greatest("np", F.lit(1)), F.col("tp") / F.greatest("nt", F.lit(1))
    return g.select("case_id", a.alias("precision"), b.alias("recall"), (2 * a * b / F.greatest(a + b, F.lit(1e-12))).alias("f1"), F.when(F.col("ns") == 0, 1.0).otherwise(F.col("hs") / F.col("ns")).alias("small_recall"), "count_error")
