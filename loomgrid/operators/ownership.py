"""Evidence, ownership and geometry of elements (case_id, set_id, e)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noisy_or(evidence: DataFrame, keys: list[str], family: str, p: str) -> DataFrame:
    """1 - prod(1 - p) over families, each family counting with its strongest evidence only."""
    strongest = evidence.groupBy(*keys, family).agg(F.max(p).alias("_p"))
    return strongest.groupBy(*keys).agg((1 - F.product(1 - F.col("_p"))).alias("probability"))


def argmax_owner(scores: DataFrame, keys: list[str], label: str, score: str, gate: Column | None = None, least_area: int = 0) -> DataFrame:
    """The label of greatest score per key; ties go to the smaller label.

    Where ``gate`` holds for some label of a key only such labels compete. Owners of fewer than ``least_area`` keys of
    a case (the first of ``keys``) lose them.
    """
    shut = F.lit(False) if gate is None else F.coalesce(gate, F.lit(False))
    best = F.max(F.struct(shut.alias("_g"), F.col(score), -F.col(label))).alias("_b")
    out = scores.groupBy(*keys).agg(best).select(*keys, (-F.col("_b.col3")).alias("owner"), F.col(f"_b.{score}").alias("owner_score"))
    if least_area <= 0:
        return out
    scope = [keys[0], "owner"] if len(keys) > 1 else ["owner"]
    large = out.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_area).drop("_n")
    return out.join(large, scope, "left_semi")


def geometry(elem: DataFrame, width: Column) -> DataFrame:
    """Area, half-open bounding box and centroid of each set; ``e = y * width + x``."""
    x, y = F.col("e") % width, F.floor(F.col("e") / width)
    return (
        elem.select("case_id", "set_id", "e").distinct().groupBy("case_id", "set_id")
        .agg(F.count(F.lit(1)).alias("area"), F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    )


def relative_geometry(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """Centre, size and area of parts as fractions of their case's root (both as from ``geometry``)."""
    r = roots.select("case_id", *(F.col(k).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1", "area")))
    w, h = F.greatest(F.col("r_x1") - F.col("r_x0"), F.lit(1)), F.greatest(F.col("r_y1") - F.col("r_y0"), F.lit(1))
    return parts.join(r, "case_id").select(
        "case_id", "set_id",
        (((F.col("x0") + F.col("x1")) / 2 - F.col("r_x0")) / w).alias("rel_cx"), (((F.col("y0") + F.col("y1")) / 2 - F.col("r_y0")) / h).alias("rel_cy"),
        ((F.col("x1") - F.col("x0")) / w).alias("rel_w"), ((F.col("y1") - F.col("y0")) / h).alias("rel_h"), (F.col("area") / F.greatest("r_area", F.lit(1))).alias("rel_area"),
    )


def cover(elem: DataFrame, root: DataFrame) -> DataFrame:
    """Per case: overlap_excess and unassigned as shares of the root, and exclusive (no element owned twice).

    root: (case_id, e). Elements outside the root don't count.
    """
    r = root.select("case_id", "e").distinct()
    n = elem.join(r, ["case_id", "e"], "left_semi").groupBy("case_id", "e").agg(F.countDistinct("set_id").alias("n"))
    c = r.join(n, ["case_id", "e"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy("case_id").agg(
        (F.sum(F.greatest(F.col("n") - 1, F.lit(0))) / F.count(F.lit(1))).alias("overlap_excess"),
        (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("unassigned"),
        (F.max("n") <= 1).alias("exclusive"),
    )


def union_metrics(predicted: DataFrame, truth: DataFrame, empty_iou: float = 1.0) -> DataFrame:
    """IoU, precision and recall per case of the union of predicted sets against the union of true ones."""
    p, t = predicted.select("case_id", "e").distinct().withColumn("p", F.lit(1)), truth.select("case_id", "e").distinct().withColumn("t", F.lit(1))
    x = p.join(t, ["case_id", "e"], "full").groupBy("case_id").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("i"))
    union = F.col("np") + F.col("nt") - F.col("i")
    return x.select("case_id", F.when(union == 0, empty_iou).otherwise(F.col("i") / union).alias("iou"), (F.col("i") / F.greatest("np", F.lit(1))).alias("precision"), (F.col("i") / F.greatest("nt", F.lit(1))).alias("recall"))


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """union / intersection / difference of element tables (case_id, e)."""
    left, right = left.select("case_id", "e").distinct(), right.select("case_id", "e").distinct()
    if how == "union":
        return left.union(right).distinct()
    return left.join(right, ["case_id", "e"], {"intersection": "left_semi", "difference": "left_anti"}[how])


def parent_residual(values: DataFrame, links: DataFrame) -> DataFrame:
    """(node, residual): a node's value less what its children account for, not below 0. values: (node, value)."""
    below = links.join(values.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.sum("value").alias("_below"))
    return values.join(below, "node", "left").select("node", F.greatest(F.col("value") - F.coalesce("_below", F.lit(0)), F.lit(0)).alias("residual"))


def ensemble(runs: dict[str, DataFrame]) -> DataFrame:
    """All rows of several models' runs, each with its ``model``; nothing is merged, absent columns are null."""
    out = None
    for model, rows in runs.items():
        one = rows.withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
