"""Competing explanations of candidate rows (case_id, set_id, name, parent, root, ...).

``pairs`` are overlap measures (case_id, a, b, inter, na, nb, iou, containment, area_coherence). Thresholds are the
operators' defaults and fixed values of the surveyed system where a comment says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .suppression import resolved


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair twice, as (case_id, x, y, inter, nx, ny, iou, containment, area_coherence)."""
    side = lambda p, q: F.struct(F.col(p).alias("x"), F.col(q).alias("y"), F.col(f"n{p}").alias("nx"), F.col(f"n{q}").alias("ny"))
    return pairs.select("case_id", "inter", "iou", "containment", "area_coherence", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("case_id", "p.*", "inter", "iou", "containment", "area_coherence")


def _about(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """Columns of candidates as seen from one side of a pair: ``x`` gives xname, ..."""
    return rows.select("case_id", F.col("set_id").alias(key), *(F.col(n).alias(f"{key}{n}") for n in names))


def _ordered(candidates: DataFrame, order: list[Column]) -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))


def _directed(candidates: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """Pairs from the candidate of earlier place (x) to the later one (y), with columns of both."""
    names = [*names, "place"]
    return both_ways(pairs).join(_about(candidates, "x", *names), ["case_id", "x"]).join(_about(candidates, "y", *names), ["case_id", "y"]).where("xplace < yplace")


def _item(case: str, set_: str) -> Column:
    return F.struct(F.col(case).alias("case_id"), F.col(set_).alias("set_id"))


def _settled(candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(case_id, set_id, kept, by, reason) of candidates with a place, by conflicts (case_id, x, y, reason)."""
    items = candidates.select(_item("case_id", "set_id").alias("item"), "place")
    r = resolved(items, conflicts.select(_item("case_id", "x").alias("first"), _item("case_id", "y").alias("second"), "reason"))
    return r.select("item.*", "kept", F.col("by.set_id").alias("by"), "reason")


def correlated_strength(candidates: DataFrame) -> DataFrame:
    """``candidates`` (with strength) less .14 (fixed value) where one is at least .85 as large as its parent's last row."""
    parent = candidates.groupBy("case_id", F.col("name").alias("parent")).agg(F.max_by("area", "set_id").alias("_pa"))
    out = candidates.join(parent, ["case_id", "parent"], "left")
    return out.withColumn("strength", F.col("strength") - F.when(F.col("area") >= 0.85 * F.col("_pa"), 0.14).otherwise(0.0)).drop("_pa")


def suppress_correlated(candidates: DataFrame, pairs: DataFrame, iou: float = 0.45, containment: float = 0.75, coherence: float = 0.55) -> DataFrame:
    """(case_id, set_id, kept, by, reason): other names for the region of a stronger candidate go.

    candidates: (case_id, set_id, name, parent, root, strength, confirmed, area). Roots must be equal unless one is
    null. A parent and its child stay apart unless they are of like size.
    """
    c = materialize(_ordered(correlated_strength(candidates), [F.desc("strength"), F.desc("name"), F.col("set_id")]), "strengths")
    e = _directed(c, pairs, ["name", "parent", "root", "strength", "confirmed"])
    kin = (F.col("xname") == F.col("yparent")) | (F.col("xparent") == F.col("yname"))
    same = (F.col("iou") >= iou) | ((F.col("containment") >= containment) & (F.col("area_coherence") >= coherence))
    # fixed values: a confirmed candidate over a weaker one inside it
    nested = (F.col("containment") >= 0.90) & (F.col("area_coherence") >= 0.25) & F.col("xconfirmed") & ~F.col("yconfirmed") & (F.col("xstrength") >= F.col("ystrength") + 0.08)
    apart = (F.col("xname") == F.col("yname")) | F.coalesce(F.col("xroot") != F.col("yroot"), F.lit(False)) | (F.coalesce(kin, F.lit(False)) & (F.col("area_coherence") < 0.72))
    e = e.where(~apart & (same | nested)).withColumn("reason", F.when(same, "correlated-semantic-overlap").otherwise("confirmed-over-weak-contained"))
    return _settled(c, e)


def resolve_regions(candidates: DataFrame, pairs: DataFrame, duplicate_iou: float = 0.82, duplicate_containment: float = 0.92, most_ratio: float = 1.35, laminar: float = 0.88, partial_containment: float = 0.35, partial_iou: float = 0.12, strong: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(decisions, kept): regions that are nested or disjoint, in order of priority.

    candidates: (case_id, set_id, name, family, utility, semantic, score, priority). decisions: (case_id, set_id, kept,
    by, reason). A duplicate from another family confirms the one that stays: kept is (case_id, set_id, score,
    families, confirmed), with the best score and all families of what confirms it.
    """
    c = materialize(_ordered(candidates, [F.desc("priority"), F.desc("set_id")]), "priorities")
    e = _directed(c, pairs, ["name", "utility", "semantic"])
    same = (F.col("iou") >= duplicate_iou) | ((F.col("containment") >= duplicate_containment) & (1 / F.col("area_coherence") <= most_ratio))
    named = F.col("xsemantic") & F.col("ysemantic") & (F.col("xname") != F.col("yname")) & (F.least("xutility", "yutility") >= strong)
    crossing = (F.col("containment") < laminar) & (F.col("containment") >= partial_containment) & (F.col("iou") >= partial_iou) & ~named
    e = e.where(same | crossing).withColumn("reason", F.when(same, "duplicate_region").otherwise("non_laminar_overlap"))
    decisions = materialize(_settled(c, e), "decisions")
    lost = decisions.where("reason = 'duplicate_region'").join(c.select("case_id", "set_id", "family", "score"), ["case_id", "set_id"])
    lost = lost.select("case_id", F.col("by").alias("set_id"), F.col("family").alias("f2"), F.col("score").alias("s2"))
    kept = decisions.where("kept").join(c.select("case_id", "set_id", "family", "score"), ["case_id", "set_id"]).join(lost, ["case_id", "set_id"], "left")
    other = F.col("f2") != F.col("family")
    kept = kept.groupBy("case_id", "set_id").agg(
        F.greatest(F.max("score"), F.max(F.when(other, F.col("s2")))).alias("score"),
        F.sort_array(F.array_distinct(F.concat(F.collect_set("family"), F.collect_set(F.when(other, F.col("f2")))))).alias("families"),
        F.coalesce(F.max(other), F.lit(False)).alias("confirmed"),
    )
    return decisions, kept


def parent_support(candidates: DataFrame, elem: DataFrame) -> DataFrame:
    """(case_id, name, e): where each parent name has support.

    candidates: (case_id, set_id, name, parent, root, key, parent_key). A name's own candidates support it. For a child
    whose parent name has no candidate of the child's root (null is a root here), the candidate that it names by key does.
    """
    own = candidates.select("case_id", "name", "set_id")
    there = candidates.select("case_id", F.col("name").alias("parent"), F.coalesce("root", F.lit("")).alias("r"), F.col("root").isNull().alias("n")).distinct()
    child = candidates.where("name <> parent").withColumns({"r": F.coalesce("root", F.lit("")), "n": F.col("root").isNull()})
    child = child.join(there, ["case_id", "parent", "r", "n"], "left_anti").select("case_id", F.col("parent").alias("name"), F.col("parent_key").alias("key"))
    by_key = candidates.where("key IS NOT NULL").groupBy("case_id", "key").agg(F.max("set_id").alias("set_id"))
    named = child.join(by_key, ["case_id", "key"]).select("case_id", "name", "set_id")
    return own.unionByName(named).distinct().join(elem, ["case_id", "set_id"]).select("case_id", "name", "e").distinct()


def specific_parts(candidates: DataFrame, pairs: DataFrame, least_strength: float = 0.4, least_share: float = 0.005, detail_share: float = 0.001, most_share: float = 0.55, structural_share: float = 0.75, containment: float = 0.8, least_root_score: float = 0.45) -> DataFrame:
    """(case_id, set_id, host): candidates that take their place out of a broader host of the same root (null roots are equal).

    candidates: (case_id, set_id, name, parent, root, score, reliability, broad, generic, structural, audited,
    independent, reranked, detail). Out of a root only candidates with evidence of their own are taken.
    """
    is_root = F.col("name") == F.col("parent")
    host = candidates.where(((is_root & F.col("root").isNotNull()) | F.col("broad")) & ~F.col("generic")).select("case_id", F.col("set_id").alias("x"), F.col("name").alias("hn"), F.col("root").alias("hr"), is_root.alias("h_root"))
    part = candidates.where(~is_root & ~F.col("generic") & ((0.45 + 0.55 * F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))) * F.col("reliability") >= least_strength)).withColumnRenamed("set_id", "y")
    x = both_ways(pairs).join(host, ["case_id", "x"]).join(part, ["case_id", "y"])
    own = F.col("structural") | F.col("audited") | F.col("reranked") | (F.col("independent") & (F.col("score") >= least_root_score))
    share = F.col("ny") / F.col("nx")
    lo = F.when(F.col("reranked") & F.col("detail"), detail_share).otherwise(least_share)
    hi = F.when(F.col("structural"), structural_share).otherwise(most_share)
    ok = (F.col("hn") != F.col("name")) & F.col("hr").eqNullSafe(F.col("root")) & (~F.col("h_root") | own) & (F.col("nx") > F.col("ny")) & share.between(lo, hi) & (F.col("inter") / F.col("ny") >= containment)
    return x.where(ok).select("case_id", F.col("y").alias("set_id"), F.col("x").alias("host"))


def semantic_match(regions: DataFrame, named: DataFrame, elem: DataFrame, pairs: DataFrame, iou: float = 0.28, containment: float = 0.72, most_ratio: float = 3.0, least_share: float = 0.72, least_support: float = 0.16, most_expansion: float = 6.0) -> DataFrame:
    """(case_id, region, set_id, score) of the named candidate that explains each region, if any.

    pairs: (case_id, a of regions, b of named, inter, na, nb, iou, containment). The best single candidate counts; for a
    region without one, at least two candidates of one name that lie in it and together cover enough of it, whose best
    by score then stands for them. named: (case_id, set_id, name, score). Ties go to the smaller id.
    """
    p = pairs.join(named.select("case_id", F.col("set_id").alias("b"), "name", "score"), ["case_id", "b"]).join(regions.select("case_id", F.col("set_id").alias("a")), ["case_id", "a"])
    p = materialize(p, "matches")
    ratio = F.greatest("na", "nb") / F.greatest(F.least("na", "nb"), F.lit(1))
    one = p.where((F.col("iou") >= iou) | ((F.col("containment") >= containment) & (ratio <= most_ratio))).withColumn("value", F.greatest("iou", 0.85 * F.col("containment")))
    one = one.groupBy("case_id", "a").agg(F.min(F.struct((-F.col("value")).alias("v"), "b")).alias("m")).select("case_id", "a", F.col("m.b").alias("b"), (-F.col("m.v")).alias("value"))
    inside = p.where(F.col("inter") / F.greatest("nb", F.lit(1)) >= least_share).join(one.select("case_id", "a"), ["case_id", "a"], "left_anti")
    region_e = elem.select("case_id", F.col("set_id").alias("a"), "e").distinct()
    covered = inside.select("case_id", "a", "b", "name").join(elem.select("case_id", F.col("set_id").alias("b"), "e"), ["case_id", "b"]).select("case_id", "a", "name", "e").distinct()
    covered = covered.join(region_e, ["case_id", "a", "e"], "left_semi").groupBy("case_id", "a", "name").agg(F.count(F.lit(1)).alias("support"))
    group = inside.groupBy("case_id", "a", "name").agg(F.count(F.lit(1)).alias("n"), F.max("na").alias("area"), F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("best"))
    group = group.where("n >= 2").join(covered, ["case_id", "a", "name"]).where((F.col("support") / F.col("area") >= least_support) & (F.col("area") / F.col("support") <= most_expansion))
    group = group.withColumn("value", F.col("support") / F.col("area") + 0.03 * F.least("n", F.lit(4)))
    group = group.groupBy("case_id", "a").agg(F.min(F.struct((-F.col("value")).alias("v"), "name", "best")).alias("m")).select("case_id", "a", F.col("m.best.b").alias("b"), (-F.col("m.v")).alias("value"))
    return one.unionByName(group).select("case_id", F.col("a").alias("region"), F.col("b").alias("set_id"), F.col("value").alias("score"))


def acceptance(c: dict[str, Column], semantic_utility: float = 0.2, generic_utility: float = 0.4, detail_utility: float = 0.46, boundary: float = 0.3) -> Column:
    """(accepted, reason) of an appearance candidate from its evidence columns. The numbers below."""
    edge = F.greatest(c["alignment"], c["closure"])
    detail = c["kind"] == "detail"
    surface = c["graph"] & (c["kind"] == "panel") & (c["root_share"] >= 0.24) & (c["closure"] >= 0.24) & (c["texture"] >= 0.32) & (c["cues"] >= 1)
    enough = F.when(detail, detail_utility).otherwise(generic_utility) - F.when(c["multi_view"], 0.08).otherwise(0.0)
    bare = detail & ~(c["multi_view"] | (edge >= boundary) | (c["chroma"] >= 0.16) | (c["texture"] >= 0.16))
    out = lambda ok, why: F.struct(ok.alias("accepted"), F.lit(why).alias("reason"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(c["semantic"], out(c["utility"] >= semantic_utility, "semantic_evidence"))
        .when(surface, out(yes, "large_structural_surface"))
        .when(c["utility"] < enough, out(no, "low_cross_cue_utility"))
        .when(c["cues"] == 0, out(no, "single_model_without_visible_boundary"))
        .when(bare, out(no, "unsupported_detail"))
        .otherwise(out(yes, "cross_cue_supported"))
    )


def three_stage_gate(rows: DataFrame) -> DataFrame:
    """``rows`` with semantic, structure, appearance and accepted; a later stage counts only if the earlier ones pass.

    rows have: visual, direct, inventory, structural, topology, bottleneck, cross_source, axis_accepted (null: not
    judged), shape_ok, conditional, evidence, physical_surface, textured, dense_gate (booleans), route, probability,
    margin, residual, support, alignment, closure, cues, shading, contact and root_share. Fixed values: the numbers.
    """
    c = F.col
    routed = (c("route").isin("base", "contextual") & (c("probability") >= 0.14) & (c("margin") >= 0.006)) | (
        c("route").isin("axis_structure_rescue", "contextual_axis_structure_rescue", "semantic_inventory_evidence_rescue") & (c("probability") >= 0.10) & (c("margin") >= 0.003)
    ) | ((c("route") == "inventory_cluster_bootstrap") & (c("probability") >= 0.12) & (c("margin") >= 0.0))
    semantic = F.when(~c("visual"), c("direct") | c("inventory")).when(c("structural"), c("inventory") & (c("residual") <= 0.24)).otherwise(c("inventory") & F.coalesce(routed, F.lit(False)))
    axis = F.coalesce(c("axis_accepted"), F.lit(True))
    strong = (c("alignment") >= 0.68) & (c("closure") >= 0.78) & (c("cues") >= 1) | (c("alignment") >= 0.78) & (c("closure") >= 0.62) & (c("cues") >= 2)
    closed = c("root_share").between(0.005, 0.55) & strong & (c("shading") <= 0.35) & ~c("textured")
    surface = c("physical_surface") & (c("alignment") >= 0.58) & (c("closure") >= 0.46)
    direct = c("direct") & (~c("evidence") | c("cross_source") | (c("support") >= F.when(c("conditional"), 0.64).otherwise(0.55)) | closed | (surface & (c("support") >= 0.50)))
    topology = c("topology") & axis & c("root_share").between(0.005, 0.82) & c("dense_gate")
    any_of = direct | c("cross_source") | (c("bottleneck") & (c("support") >= 0.50)) | closed | (c("support") >= 0.55) | (c("structural") & (c("residual") <= 0.24)) | topology
    physical = (c("contact") >= 0.10) | (c("support") >= 0.72) | c("topology") | c("bottleneck")
    light_only = (c("shading") >= 0.42) & ~surface & ~(physical & (c("cross_source") | c("direct")))
    seen = (c("shading") <= 0.50) & (c("alignment") >= 0.55) & ((c("closure") >= 0.28) | (c("cues") >= 2) | c("cross_source"))
    appearance = F.when(~c("visual") | c("direct"), ~light_only).otherwise(seen)
    out = rows.withColumn("semantic", semantic).withColumn("structure", F.col("semantic") & axis & c("shape_ok") & any_of)
    out = out.withColumn("appearance", F.col("semantic") & F.col("structure") & appearance)
    stage = F.when(~F.col("semantic"), "semantic").when(~F.col("structure"), "structure").when(~F.col("appearance"), "appearance")
    return out.withColumn("accepted", F.col("appearance")).withColumn("failed_stage", stage)


def root_form(area: Column, width: Column, height: Column, contour_area: Column, perimeter: Column) -> Column:
    """(accepted, reason) of a root's form: open and ambiguous forms go. The numbers below."""
    fill = area / F.greatest(width * height, F.lit(1))
    aspect = F.least(width, height) / F.greatest(width, height, F.lit(1))
    compact = 4 * F.pi() * contour_area / F.greatest(perimeter * perimeter, F.lit(1.0))
    open_ = (fill < 0.62) & (aspect >= 0.55) & (compact < 0.40)
    return F.when(area <= 0, F.struct(F.lit(False).alias("accepted"), F.lit("empty_root").alias("reason"))).otherwise(F.struct((~open_).alias("accepted"), F.when(open_, "ambiguous_open_form").otherwise("root_geometry_supported").alias("reason")))


def extraction_scope(components: DataFrame, requested: Column) -> DataFrame:
    """(case_id, scope, status) of images by their foreground components (case_id, area) and (image_area, border).

    An entire scene with one clear subject on a plain border becomes its primary asset. Components of less than a
    thousandth of the image, or 18 pixels, don't count. Fixed values: the numbers below.
    """
    big = F.col("area") >= F.greatest(F.lit(18), F.bround(0.001 * F.col("image_area")))
    g = components.groupBy("case_id").agg(F.max("image_area").alias("image"), F.max("border").alias("border"), F.sort_array(F.collect_list(F.when(big, F.col("area"))), False).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v)
    first, second = F.coalesce(F.get("a", 0), F.lit(0)), F.coalesce(F.get("a", 1), F.lit(0))
    share = total / F.greatest("image", F.lit(1))
    single = (F.col("border") <= 24.0) & share.between(0.035, 0.46) & (first / F.greatest(total, F.lit(1)) >= 0.88) & (second / F.greatest(first, F.lit(1)) <= 0.16)
    explicit = requested != "Entire scene"
    scope = F.when(~explicit & single, "Primary asset").otherwise(requested)
    return g.select("case_id", scope.alias("scope"), F.when(explicit, "kept_explicit_scope").when(single, "resolved_single_subject").otherwise("kept_scene_scope").alias("status"))


def axis_gate(elem: DataFrame, parts: DataFrame, least_anchor: float = 0.35, least_margin: float = 0.08, hard_margin: float = 0.55, refined_margin: float = 0.35) -> DataFrame:
    """(root, part, coordinate, accepted) of named parts along their root's main axis; roots without a clear direction judge nothing.

    elem: (root, x, y). parts: (root, part, cx, cy, expected, tolerance, weight, refined, guided); expected is null where a
    part has no place on the axis. The axis is the main component of the root's elements; the parts with a clear
    place say which end is which, by weighted squared error. Guided parts stay.
    """
    m = elem.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("a"), F.covar_samp("y", "y").alias("b"), F.covar_samp("x", "y").alias("c")).where("n >= 8")
    angle = 0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))
    m = materialize(m.select("root", "mx", "my", F.cos(angle).alias("dx"), F.sin(angle).alias("dy")), "axes")
    along = lambda x, y: (F.col(x) - F.col("mx")) * F.col("dx") + (F.col(y) - F.col("my")) * F.col("dy")
    span = elem.join(m, "root").groupBy("root").agg(F.min(along("x", "y")).alias("lo"), F.max(along("x", "y")).alias("hi"))
    m = m.join(span, "root").withColumns({"mid": (F.col("lo") + F.col("hi")) / 2, "half": (F.col("hi") - F.col("lo")) / 2}).where("half >= 2.0")
    clip = lambda v: F.least(F.greatest(v, F.lit(-1.25)), F.lit(1.25))
    p = parts.where("expected IS NOT NULL").join(m, "root").withColumn("at", clip((along("cx", "cy") - F.col("mid")) / F.col("half")))
    anchor = F.abs("expected") >= least_anchor
    weight = F.when(anchor, F.greatest(F.lit(1e-4), F.abs("expected") * F.col("weight")))
    error = lambda s: F.sum(weight * (s * F.col("at") - F.col("expected")) ** 2)
    w = p.groupBy("root").agg(error(1).alias("plus"), error(-1).alias("minus"), F.sum(weight).alias("w")).where("w IS NOT NULL")
    w = w.where(F.abs(F.col("plus") - F.col("minus")) / F.greatest("w", F.lit(1e-8)) >= least_margin).select("root", F.when(F.col("plus") < F.col("minus"), 1.0).otherwise(-1.0).alias("sign"))
    x = p.join(w, "root").withColumn("coordinate", F.col("sign") * F.col("at"))
    limit = F.least(F.lit(2.0), F.col("tolerance") + F.when(F.col("refined"), refined_margin).otherwise(hard_margin))
    return x.select("root", "part", "coordinate", ((F.abs(F.col("coordinate") - F.col("expected")) <= limit) | F.col("guided")).alias("accepted"))
