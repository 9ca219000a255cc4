"""Region features, gates, groups and composition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .validation import ladder


def shape(elem: DataFrame, width: Column) -> DataFrame:
    """(case_id, set_id, area, elongation) by the eigenvalues of each set's covariance; 1 for round sets."""
    x, y = (F.col("e") % width).cast("double"), F.floor(F.col("e") / width).cast("double")
    s = elem.select("case_id", "set_id", "e").distinct().groupBy("case_id", "set_id").agg(F.count(F.lit(1)).alias("area"), F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    mid, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    return s.select("case_id", "set_id", "area", F.sqrt((mid + gap + 1e-6) / F.greatest(mid - gap + 1e-6, F.lit(1e-6))).alias("elongation"))


def region_kind(area_share: Column, elongation: Column, detail: float = 0.015, strip: float = 3.2) -> Column:
    """detail, strip or panel."""
    return ladder([("detail", area_share < detail), ("strip", elongation >= strip)], "panel")


def ensemble_gate(regions: DataFrame, named: int) -> DataFrame:
    """Regions (root, semantic, generic) without the generic ones of roots that have at least ``named`` distinct semantics."""
    n = regions.where("NOT generic").groupBy("root").agg(F.countDistinct("semantic").alias("n")).where(F.col("n") >= named).select("root", F.lit(True).alias("generic"))
    return regions.join(n, ["root", "generic"], "left_anti")


def log_gap_split(rows: DataFrame, key: str, value: str, least_gap: float) -> DataFrame:
    """``rows`` with ``side`` low or high of the largest gap of ln(value) in their key; low if no gap is large enough."""
    w = Window.partitionBy(key).orderBy("v")
    d = rows.select(key, F.col(value).alias("v")).distinct().withColumn("g", F.ln("v") - F.ln(F.lag("v").over(w)))
    cut = d.where(F.col("g") >= least_gap).groupBy(key).agg(F.max(F.struct("g", (-F.col("v")).alias("v"))).alias("m")).select(key, (-F.col("m.v")).alias("_cut"))
    return rows.join(cut, key, "left").withColumn("side", F.when(F.col(value) >= F.col("_cut"), "high").otherwise("low")).drop("_cut")


def groups(parts: DataFrame) -> DataFrame:
    """(case_id, asset_id, semantic, members, bbox, area) of parts with their boxes, members in order of instance_index."""
    m = F.transform(F.sort_array(F.collect_list(F.struct("instance_index", "part_id"))), lambda s: s["part_id"])
    box = F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return parts.groupBy("case_id", "asset_id", "semantic").agg(m.alias("members"), box.alias("bbox"), F.sum("area").alias("area"))


def rebind(overlaps: DataFrame) -> DataFrame:
    """(case_id, group_id, part_id) from overlaps (case_id, group_id, part_id, n): groups in order of their largest overlap
    each claim their best part that is free; other parts go to the group they overlap most; an empty group shares its best part."""
    kinds = dict(overlaps.dtypes)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["n", "group_id", "part_id"], ascending=[False, True, True])
        best, owner = t.drop_duplicates("group_id"), {}
        out = []
        for g in best["group_id"]:
            own = t[t["group_id"] == g]
            free = own[~own["part_id"].isin(owner)]
            p = (free if len(free) else own)["part_id"].iloc[0]
            owner.setdefault(p, g)
            out.append((g, p))
        out += [(g, p) for g, p in t.drop_duplicates("part_id")[["group_id", "part_id"]].itertuples(index=False) if p not in owner]
        return pd.DataFrame([(t["case_id"].iloc[0], g, p) for g, p in out], columns=["case_id", "group_id", "part_id"])

    return overlaps.groupBy("case_id").applyInPandas(one, f"case_id {kinds['case_id']}, group_id {kinds['group_id']}, part_id {kinds['part_id']}")


def representatives(views: DataFrame) -> DataFrame:
    """The row of each cluster (cluster, item, score, agreement, edge) with the greatest .60 score + .24 agreement + .16 edge."""
    # fixed values: the weights
    s = 0.60 * F.col("score") + 0.24 * F.col("agreement") + 0.16 * F.col("edge")
    w = Window.partitionBy("cluster").orderBy(F.desc("value"), "item")
    return views.withColumn("value", s).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conditioned(children: DataFrame, parents: DataFrame, weight: float) -> DataFrame:
    """(item, label, probability): softmax of ln p plus ``weight`` times ln of the parent label's probability.

    children: (item, label, parent, p); parents: (item, parent, p).
    """
    w = Window.partitionBy("item")
    x = children.join(parents.withColumnRenamed("p", "pp"), ["item", "parent"])
    x = x.withColumn("z", F.ln(F.greatest("p", F.lit(1e-12))) + weight * F.ln(F.greatest("pp", F.lit(1e-12))))
    e = F.exp(F.col("z") - F.max("z").over(w))
    return x.withColumn("e", e).select("item", "label", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def compose(visible: Column, full: Column, source: Column, generated: Column) -> Column:
    """A pixel of a completed object: the source where it is visible, generated where it is hidden, null outside."""
    return F.when(visible, source).when(full, generated)


def completion_score(quality: Column, recall: Column, precision: Column, added: Column, visible: Column, lateral: Column, span: Column) -> Column:
    """Combined evidence of a completed mask. ``added``, ``visible``: areas; ``lateral``: precision across the seam. The numbers."""
    least = F.greatest(F.lit(6), F.bround(visible * 0.003))
    s = quality * recall * precision * lateral * F.least(F.lit(1.0), 1.30 / span) * F.least(F.lit(1.0), added / F.greatest(F.lit(1), least * 4))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def completion_reason(quality: Column, recall: Column, precision: Column, added: Column, visible: Column, lateral: Column, span: Column) -> Column:
    """Why a completed mask is rejected, or accepted; the first rule that holds counts. The limits."""
    return ladder(
        [
            ("low_model_quality", quality < 0.30),
            ("visible_target_not_preserved", recall < 0.82),
            ("proposal_leaks_outside_occluder_search", precision < 0.65),
            ("no_supported_hidden_continuation", added < F.greatest(F.lit(6), F.bround(visible * 0.003))),
            ("implausible_expansion", added > F.bround(visible * 1.5)),
            ("implausible_lateral_spread", lateral < 0.78),
            ("implausible_orthogonal_span", span > 1.30),
            ("weak_combined_evidence", completion_score(quality, recall, precision, added, visible, lateral, span) < 0.45),
        ],
        "accepted",
    )


def occluders(contacts: DataFrame, most: int = 3) -> DataFrame:
    """The neighbours that most likely hide a set, ranked: (case_id, set_id, other, score, rank).

    contacts: (case_id, set_id, visible_area, other, other_area, contact, search), contact being the neighbour's part of
    the ring around the set and search its part within reach. Fixed values: the numbers.
    """
    c = F.col
    near = (c("contact") >= F.greatest(F.lit(3), F.bround(F.sqrt("visible_area") * 0.08))) & (c("search") >= F.greatest(F.lit(8), F.bround(c("visible_area") * 0.003)))
    share = c("contact") / F.greatest(F.lit(1.0), F.sqrt(c("visible_area") * c("other_area")))
    reach = F.least(F.lit(1.0), c("search") / F.greatest(F.lit(1.0), c("visible_area") * 0.35))
    x = contacts.where(near).withColumn("score", share * (0.65 + 0.35 * reach))
    w = Window.partitionBy("case_id", "set_id").orderBy(F.desc("score"), "other")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("case_id", "set_id", "other", "score", "rank")


def slug_ids(rows: DataFrame, scope: list[str], slug: str, place: str) -> DataFrame:
    """``rows`` with ``slug_id``: the slug, with _2, _3, ... where it repeats in its scope, by place."""
    n = F.row_number().over(Window.partitionBy(*scope, slug).orderBy(place))
    return rows.withColumn("slug_id", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), n.cast("string"))))


def width_profile(elem: DataFrame, bins: int) -> DataFrame:
    """(root, bin, n, width) along the main axis of elements (root, x, y): the width of a bin is the distance of the 5th and 95th
    percentile across the axis; bins without one are interpolated, and three neighbours averaged (ends count twice).

    Roots of fewer than max(24, bins) elements, shorter than 8 or with too few filled bins have no profile.
    """
    m = elem.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("a"), F.covar_samp("y", "y").alias("b"), F.covar_samp("x", "y").alias("c")).where(F.col("n") >= max(24, bins))
    angle = 0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))
    x = elem.join(m.select("root", "mx", "my", F.cos(angle).alias("dx"), F.sin(angle).alias("dy")), "root")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    x = x.select("root", (dx * F.col("dx") + dy * F.col("dy")).alias("u"), (dy * F.col("dx") - dx * F.col("dy")).alias("v"))
    span = x.groupBy("root").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("hi - lo >= 8.0")
    x = x.join(span, "root").withColumn("bin", F.least(F.floor(F.round((F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 9)), F.lit(bins - 1)).cast("int"))
    width = F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))
    g = x.groupBy("root", "bin").agg(F.count(F.lit(1)).alias("n"), width.alias("w")).withColumn("w", F.when((F.col("n") >= 2) & (F.col("w") > 0), F.col("w")))
    filled = g.groupBy("root").agg(F.count("w").alias("_f")).where(F.col("_f") >= max(4, bins // 4)).select("root")
    g = filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(g, ["root", "bin"], "left")
    w = Window.partitionBy("root").orderBy("bin")
    here = F.when(F.col("w").isNotNull(), F.struct("bin", "w"))
    g = g.withColumn("_p", F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_q", F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("_p.w") + (F.col("_q.w") - F.col("_p.w")) * (F.col("bin") - F.col("_p.bin")) / F.greatest(F.col("_q.bin") - F.col("_p.bin"), F.lit(1))
    g = g.withColumn("w", F.coalesce(between, "_p.w", "_q.w"))
    near = (F.coalesce(F.lag("w").over(w), F.col("w")) + F.col("w") + F.coalesce(F.lead("w").over(w), F.col("w"))) / 3
    return g.select("root", "bin", F.coalesce("n", F.lit(0)).alias("n"), near.alias("width"))


def nearest_colour(r: Column, g: Column, b: Column, palette: list[tuple[int, int, int]]) -> Column:
    """Index of the nearest palette colour; ties go to the first. The palette is a literal, so nothing is joined."""
    d = F.array(*(F.struct(((r - p[0]) * (r - p[0]) + (g - p[1]) * (g - p[1]) + (b - p[2]) * (b - p[2])).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(palette)))
    return F.array_min(d)["k"]


def canonical(name: Column, by_category: dict[str, str], by_domain: dict[str, str]) -> Column:
    """A name's alias in its category, else in its domain, else itself."""
    pick = lambda m: F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), name) if m else F.lit(None)
    return F.coalesce(pick(by_category), pick(by_domain), name)


def known_classes(rows: DataFrame, column: str, classes: int) -> DataFrame:
    """``rows`` whose class is a number from 0; others raise when they are read."""
    ok = F.col(column).between(0, classes - 1)
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))


def region_names(regions_: DataFrame) -> DataFrame:
    """``regions_`` (case_id, set_id, root, root_key, generic, kind, x0, y0, area) with key and name: numbered in each root from top to bottom,
    left to right, large ones first; generic ones are named by kind and number in it."""
    order = ["y0", "x0", F.desc("area"), F.col("set_id")]
    n = F.row_number().over(Window.partitionBy("case_id", "root").orderBy(*order))
    k = F.row_number().over(Window.partitionBy("case_id", "root", "generic", "kind").orderBy(*order))
    key = F.format_string("%s/visual-region:%02d", F.col("root_key"), n)
    return regions_.withColumn("key", key).withColumn("name", F.when(F.col("generic"), F.format_string("%s_visual_%s_%02d", F.col("root"), F.col("kind"), k)))


def segment_errors(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(case_id, segment, weight, mean, error) of segments (case_id, segment, start, end) of weighted points (case_id, place, x, w):
    the weighted mean and squared error of places start to end - 1; infinite without weight.

    Running sums make every segment two look-ups, however long it is.
    """
    w = Window.partitionBy("case_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    up = points.select("case_id", F.col("place"), *(F.sum(e).over(w).alias(n) for n, e in (("sw", F.col("w")), ("sx", F.col("w") * F.col("x")), ("sq", F.col("w") * F.col("x") ** 2))))
    at = lambda s: up.select("case_id", (F.col("place") + 1).alias(s), *(F.col(k).alias(f"{s}_{k}") for k in ("sw", "sx", "sq")))
    x = segments.join(at("end"), ["case_id", "end"], "left").join(at("start"), ["case_id", "start"], "left")
    d = lambda k: F.coalesce(f"end_{k}", F.lit(0.0)) - F.coalesce(f"start_{k}", F.lit(0.0))
    weight, mean = d("sw"), d("sx") / d("sw")
    return x.select("case_id", "segment", weight.alias("weight"), F.when(weight > 0, mean).otherwise(0.0).alias("mean"), F.when(weight > 0, F.greatest(d("sq") - d("sw") * mean * mean, F.lit(0.0))).otherwise(float("inf")).alias("error"))
