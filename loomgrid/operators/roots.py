"""Roots: which object a set of candidates belongs to, and which candidate stands for it.

Root rows are (case_id, root, name, ...) with ``root`` as their key. Weights and limits are fixed values of the
surveyed system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import clip, min_max
from .graph import connected_components
from .hypotheses import both_ways


def is_root(name: Column, parent: Column, parent_key: Column, index: Column | None = None) -> Column:
    """A candidate of its own parent's name, without a parent key (and with a root index, if asked for)."""
    own = (name == parent) & parent_key.isNull()
    return own if index is None else own & index.isNotNull()


def routed_roots(roots: DataFrame, primary: DataFrame) -> DataFrame:
    """Per case the roots (case_id, root, place) whose key is ``primary`` (case_id, root); without any, the first by place."""
    w = Window.partitionBy("case_id")
    x = roots.join(primary.select("case_id", "root").distinct().withColumn("_p", F.lit(1)), ["case_id", "root"], "left")
    x = x.withColumn("_any", F.max("_p").over(w)).withColumn("_n", F.row_number().over(w.orderBy("place")))
    return x.where("_p = 1 OR (_any IS NULL AND _n = 1)").drop("_p", "_any", "_n")


def namespaces(roots: DataFrame) -> DataFrame:
    """``roots`` (case_id, root, name, x0, y0, x1, y1) with ``namespace``: the name, numbered in order of box and key where it repeats."""
    w = Window.partitionBy("case_id", "name")
    k = F.row_number().over(w.orderBy("x0", "y0", "x1", "y1", "root"))
    repeated = F.count(F.lit(1)).over(w) > 1
    return roots.withColumn("namespace", F.when(repeated, F.format_string("%s_asset_%02d", F.col("name"), k)).otherwise(F.col("name")))


def propagate_identity(candidates: DataFrame, roots: DataFrame, fields: list[str]) -> DataFrame:
    """``candidates`` (case_id, root, identity fields) that take the fields of their root's row, unless they have the first one.

    ``propagated`` tells which did; a root's null fields leave what is there.
    """
    own = roots.where(F.col(fields[0]).isNotNull()).select("case_id", "root", *(F.col(f).alias(f"_{f}") for f in fields)).dropDuplicates(["case_id", "root"])
    x = candidates.join(own, ["case_id", "root"], "left")
    takes = F.col(fields[0]).isNull() & F.col(f"_{fields[0]}").isNotNull()
    x = x.withColumn("propagated", takes)
    return x.withColumns({f: F.when(F.col("propagated"), F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def root_parent(parts: DataFrame, supports: DataFrame, marker: str = "/visual-region:") -> DataFrame:
    """(case_id, part, parent) by the key before ``marker``: of the supports (case_id, key, asset, root, support, part) with that
    key and asset, and the part's root unless that is null, the one of most support (ties: smaller part)."""
    p = parts.where(F.contains("key", F.lit(marker))).select("case_id", F.col("part").alias("child"), F.substring_index("key", marker, 1).alias("key"), "asset", F.col("root").alias("wanted"))
    # a key's supports meet its parts as the best one of each root, and the best of all
    best = supports.groupBy("case_id", "key", "asset", "root").agg(F.min(F.struct((-F.col("support")).alias("s"), "part")).alias("m"))
    best = best.groupBy("case_id", "key", "asset").agg(F.min("m").alias("m"), F.collect_list(F.struct("root", "m")).alias("roots"))
    own = F.get(F.filter("roots", lambda r: r["root"] == F.col("wanted")), F.lit(0))
    x = p.join(best, ["case_id", "key", "asset"]).withColumn("m", F.when(F.col("wanted").isNull(), F.col("m")).otherwise(own["m"]))
    x = x.where("m IS NOT NULL").groupBy("case_id", F.col("child").alias("part")).agg(F.min("m").alias("m"))
    return x.select("case_id", "part", F.col("m.part").alias("parent"))


def root_scores(roots: DataFrame) -> DataFrame:
    """``roots`` with score, salience and the measures that go into them.

    roots: (case_id, root, score, mask_quality, cx, cy, area, x0, y0, x1, y1, width, height, children, child_names,
    coherence, alignment, border_pixels, band, evidence, probability); evidence may be null.
    """
    c = F.col
    image = F.greatest(c("width") * c("height"), F.lit(1))
    area, boxed = c("area") / image, F.greatest(c("x1") - c("x0"), F.lit(0)) * F.greatest(c("y1") - c("y0"), F.lit(0)) / image
    extent = clip(F.greatest((c("x1") - c("x0")) / F.greatest("width", F.lit(1)), (c("y1") - c("y0")) / F.greatest("height", F.lit(1))), 0.0, 1.0)
    detector, quality = clip(c("score") / 0.65, 0.0, 1.0), clip(F.coalesce("mask_quality", F.lit(0.5)), 0.0, 1.0)
    centre = clip(1 - F.hypot((c("cx") / c("width") - 0.5) / 0.5, (c("cy") / c("height") - 0.5) / 0.5) / F.sqrt(F.lit(2.0)), 0.0, 1.0)
    sized = F.exp(-0.70 * F.abs(F.ln(F.greatest(area, F.lit(1e-5)) / 0.20)))
    salient = lambda a: clip(F.sqrt(a / 0.20), 0.0, 1.0)
    children = clip(0.65 * c("child_names") / 10.0 + 0.35 * c("children") / 20.0, 0.0, 1.0)
    sides = (c("x0") <= c("band")).cast("int") + (c("y0") <= c("band")).cast("int") + (c("x1") >= c("width") - c("band")).cast("int") + (c("y1") >= c("height") - c("band")).cast("int")
    border = clip(c("border_pixels") / F.greatest("area", F.lit(1)) / 0.035, 0.0, 1.0) * 0.08 + F.least(F.lit(0.10), sides * 0.025)
    large = 0.24 * clip((area - 0.82) / 0.18, 0.0, 1.0)
    out = roots.withColumns({"area_share": area, "box_share": boxed, "frame_extent": extent, "detector": detector, "quality": quality, "centre": centre, "area_salience": salient(area), "box_salience": salient(boxed), "child_score": children, "touched_sides": sides})
    salience = 0.14 * detector + 0.12 * quality + 0.15 * salient(area) + 0.14 * salient(boxed) + 0.07 * centre + 0.12 * c("coherence") + 0.12 * clip(c("alignment"), 0.0, 1.0) + 0.07 * extent + 0.07 * c("probability") - border - large
    plain = 0.25 * detector + 0.10 * quality + 0.18 * sized + 0.17 * centre + 0.20 * children + 0.10 * c("coherence") - border
    known = 0.10 * detector + 0.08 * quality + 0.15 * sized + 0.15 * centre + 0.20 * children + 0.08 * c("coherence") + 0.28 * clip(c("evidence"), 0.0, 1.0) - border
    return out.withColumn("salience", salience).withColumn("routing_score", F.when(c("evidence").isNull(), plain).otherwise(known))


def physical_hypotheses(pairs: DataFrame, geometry: DataFrame, diagonal: Column, iou: float = 0.58, box_iou: float = 0.72, box_ratio: float = 0.45, box_distance: float = 0.12, containment: float = 0.88, least_ratio: float = 0.38, distance: float = 0.16) -> DataFrame:
    """(case_id, a, b): pairs that show one physical object, by overlap, by their boxes, or by containment at like size and place.

    geometry: (case_id, set_id, area, x0, y0, x1, y1, cx, cy).
    """
    side = lambda s: geometry.select("case_id", F.col("set_id").alias(s), *(F.col(k).alias(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1", "cx", "cy")))
    x = pairs.join(side("a"), ["case_id", "a"]).join(side("b"), ["case_id", "b"])
    c = F.col
    w = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0))
    h = F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0))
    box = lambda s: (c(f"{s}_x1") - c(f"{s}_x0")) * (c(f"{s}_y1") - c(f"{s}_y0"))
    boxes = w * h / F.greatest(box("a") + box("b") - w * h, F.lit(1))
    apart = F.hypot(c("a_cx") - c("b_cx"), c("a_cy") - c("b_cy")) / F.greatest(diagonal, F.lit(1.0))
    by_box = (boxes >= box_iou) & (c("area_coherence") >= box_ratio) & (apart <= box_distance)
    nested = (c("containment") >= containment) & (c("area_coherence") >= least_ratio) & (apart <= distance)
    return x.where((c("iou") >= iou) | by_box | nested).select("case_id", "a", "b")


def physical_groups(roots: DataFrame, same: DataFrame) -> DataFrame:
    """``roots`` (case_id, set_id, root) with ``group``: physical:01, ... numbered in order of each component's smallest key."""
    linked = connected_components(same.select(F.struct("case_id", F.col("a").alias("set_id")).alias("a"), F.struct("case_id", F.col("b").alias("set_id")).alias("b")))
    linked = linked.select("id.*", F.col("component.set_id").alias("_c"))
    x = roots.join(linked, ["case_id", "set_id"], "left").withColumn("_c", F.coalesce("_c", "set_id"))
    least = x.groupBy("case_id", "_c").agg(F.min("root").alias("_r"))
    named = least.withColumn("group", F.format_string("physical:%02d", F.row_number().over(Window.partitionBy("case_id").orderBy("_r", "_c")))).drop("_r")
    return x.join(named, ["case_id", "_c"]).drop("_c")


def arbitrate(roots: DataFrame) -> DataFrame:
    """``roots`` with arbitration (a name's claim to its group), representation (a mask's claim to stand for its name) and best.

    roots: (case_id, group, root, name, origin, evidence, contrast, detector, profile_score, specificity,
    profile_specificity, child_score, priority, area_share, salience, quality, routing_score). ``best`` marks each
    group's name of greatest claim, at its row of greatest representation.
    """
    c = F.col
    w, own = Window.partitionBy("case_id", "group"), Window.partitionBy("case_id", "group", "name")
    x = roots.withColumn("_e", c("evidence") + 0.50 * F.coalesce("contrast", F.lit(0.0)))
    lo, hi = F.min("_e").over(w), F.max("_e").over(w)
    x = x.withColumn("evidence_rank", F.when(c("_e").isNull() | (hi - lo < 1e-6), 0.50).otherwise((c("_e") - lo) / (hi - lo)))
    spec, prof = clip(c("specificity"), 0.0, 1.0), clip(c("profile_specificity"), 0.0, 1.0)
    x = x.withColumn("arbitration", 0.26 * F.greatest(c("detector"), clip(c("profile_score") / 0.65, 0.0, 1.0)) + 0.30 * c("evidence_rank") + 0.16 * spec + 0.10 * prof + 0.04 * c("child_score") + 0.14 * c("priority"))
    cover = clip(c("area_share") / F.greatest(F.max("area_share").over(w), F.lit(1e-6)), 0.0, 1.0)
    origins = F.size(F.collect_set("origin").over(own))
    x = x.withColumn("representation", 0.27 * c("salience") + F.when(origins == 1, 0.20).otherwise(0.18) * cover + 0.14 * prof + 0.06 * spec + 0.08 * c("detector") + 0.09 * c("quality") + 0.04 * c("evidence_rank") + 0.14 * c("priority"))
    x = x.withColumn("_claim", F.max("arbitration").over(own))
    first = F.row_number().over(w.orderBy(F.desc("_claim"), "name", F.desc("representation"), F.desc("routing_score"), "root"))
    return x.withColumn("best", first == 1).drop("_e", "_claim")


def salient_group(groups: DataFrame, tolerance: float = 0.015) -> DataFrame:
    """``groups`` with eligible, competitive and owned, per case.

    groups: (case_id, group, score, physical, area_share, frame_extent, box_salience, area_salience, and of its row of
    global rank one: has_global, accepted, global_priority, global_area, global_physical). A small global part of a
    larger salient object isn't eligible (unless none is). Competitive ones are near the best; owned ones are those
    that the global proposal backs within a gap.
    """
    c, w = F.col, Window.partitionBy("case_id")
    small = groups.where(c("has_global") & (c("global_area") <= 0.18) & ~(c("accepted") & (c("global_area") >= 0.10) & (c("global_physical") >= 0.55)))
    other = groups.where((c("physical") >= 0.72) & (c("frame_extent") >= 0.55)).select("case_id", F.col("group").alias("o"), F.col("area_share").alias("oa"), F.col("score").alias("os"))
    part = small.join(other, "case_id").where((c("o") != c("group")) & (c("oa") >= F.greatest(F.lit(0.30), 2.5 * c("global_area"))) & (c("os") >= c("score") - 0.12)).select("case_id", "group").distinct().withColumn("_s", F.lit(True))
    x = groups.join(part, ["case_id", "group"], "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    x = x.withColumn("eligible", ~c("_s") | F.min("_s").over(w))
    x = x.withColumn("_top", F.max(F.when(c("eligible"), c("score"))).over(w))
    gap = c("_top") - c("score")
    shaped = (c("frame_extent") >= 0.80) | (c("box_salience") >= 0.95) & (c("area_salience") >= 0.70) | (gap <= 0.06) & (c("frame_extent") >= 0.72) & (c("area_salience") >= 0.55)
    owned = c("eligible") & c("has_global") & (c("global_priority") >= 0.65) & (c("physical") >= 0.45) & (gap <= F.when(c("accepted"), 0.23).otherwise(0.18)) & (c("accepted") | shaped)
    return x.withColumn("competitive", c("eligible") & (gap <= tolerance)).withColumn("owned", owned).drop("_s", "_top")


def prompt_consensus(roots: DataFrame, pairs: DataFrame, least_support: int = 2) -> DataFrame:
    """(case_id, group, set_id, supports, span, selected): groups that other groups' fragments support, per case.

    roots: (case_id, group, set_id, direct, probability, routing_score, area_share, touched_sides, box_share,
    group_score). A group's representative is its best direct row; an eligible one is supported by the other eligible
    representatives that it contains or that contain it by .38. The best by supports, span and probability needs enough.
    """
    c = F.col
    best = F.row_number().over(Window.partitionBy("case_id", "group").orderBy(F.desc("probability"), F.desc("routing_score"), "set_id"))
    r = roots.where("direct").withColumn("_n", best).where("_n = 1").drop("_n")
    r = r.where((c("probability") >= 0.50) & (c("area_share") <= 0.72) & (c("touched_sides") <= 2))
    ids = r.select("case_id", F.col("set_id").alias("x"))
    near = both_ways(pairs).where(c("containment") >= 0.38).join(ids, ["case_id", "x"], "left_semi").join(ids.withColumnRenamed("x", "y"), ["case_id", "y"], "left_semi")
    n = near.groupBy("case_id", F.col("x").alias("set_id")).agg(F.countDistinct("y").alias("supports"))
    x = r.join(n, ["case_id", "set_id"], "left").withColumn("supports", F.coalesce("supports", F.lit(0)).cast("long"))
    x = x.withColumn("span", 0.50 * c("probability") + 0.28 * F.least(F.lit(1.0), c("box_share") / 0.55) + 0.22 * c("group_score"))
    first = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("supports"), F.desc("span"), F.desc("probability"), "group"))
    return x.withColumn("selected", (first == 1) & (c("supports") >= least_support)).select("case_id", "group", "set_id", "supports", "span", "selected")


def scene_objects(groups: DataFrame, least_pixels: int = 64, least_share: float = 0.0005, least_score: float = 0.2, most: int = 48, layer_share: float = 0.2) -> DataFrame:
    """``groups`` (case_id, group, name, area, image_area, score, cx, cy) with reason (null if taken), object and role.

    Groups that are too small or weak go, then those beyond ``most`` by score, area and id; the others are numbered
    from top to bottom, left to right.
    """
    c = F.col
    share = c("area") / F.greatest("image_area", F.lit(1))
    x = groups.withColumn("reason", F.when(c("area") < least_pixels, "too_few_pixels").when(share < least_share, "too_small_for_scene_root").when(c("score") < least_score, "weak_physical_group"))
    place = F.row_number().over(Window.partitionBy("case_id", c("reason").isNull()).orderBy(F.desc("score"), F.desc("area"), F.desc("group")))
    x = x.withColumn("_n", place).withColumn("reason", F.when(c("reason").isNull() & (c("_n") > most), "scene_root_limit").otherwise(c("reason")))
    number = F.row_number().over(Window.partitionBy("case_id", c("reason").isNull()).orderBy("cy", "cx", "name", F.desc("area")))
    taken = c("reason").isNull()
    x = x.withColumn("object", F.when(taken, F.format_string("object_%03d", number)))
    return x.withColumn("role", F.when(taken, F.when((c("name") == "terrain") & (share >= layer_share), "scene_layer").otherwise("object"))).drop("_n")


def reconcile(existing: DataFrame, escalated: DataFrame, pairs: DataFrame, iou: float = 0.90, containment: float = 0.97, coherence: float = 0.84) -> tuple[DataFrame, DataFrame]:
    """(roots, actions): escalated roots (case_id, set_id, name, prompt, reliability) that show an existing root of their name give
    it their prompt and reliability; others are added.

    pairs: (case_id, a of existing, b of escalated, iou, containment, area_coherence). If several meet one root, the
    last by id gives the prompt and the greatest the reliability.
    """
    c = F.col
    same = (c("iou") >= iou) | ((c("containment") >= containment) & (c("area_coherence") >= coherence))
    m = pairs.where(same).join(existing.select("case_id", F.col("set_id").alias("a"), "name"), ["case_id", "a"]).join(escalated.select("case_id", F.col("set_id").alias("b"), "name", "prompt", "reliability"), ["case_id", "b", "name"])
    m = m.groupBy("case_id", F.col("b").alias("set_id"), "prompt", "reliability").agg(F.max(F.struct("iou", "containment", "area_coherence", F.col("a").alias("a"))).alias("m"))
    m = m.select("case_id", "set_id", "prompt", "reliability", F.col("m.a").alias("matched"), F.col("m.iou").alias("iou"))
    action = F.when(c("matched").isNull(), "retained_distinct_geometry").otherwise("semantic_evidence_merged_geometry_preserved")
    actions = escalated.select("case_id", "set_id").join(m.select("case_id", "set_id", "matched", "iou"), ["case_id", "set_id"], "left").select("case_id", "set_id", action.alias("action"), "matched", F.coalesce("iou", F.lit(0.0)).alias("iou"))
    gives = m.groupBy("case_id", F.col("matched").alias("set_id")).agg(F.max_by(F.when(c("prompt") != "", c("prompt")), F.when(c("prompt") != "", c("set_id"))).alias("_p"), F.max("reliability").alias("_r"))
    x = existing.join(gives, ["case_id", "set_id"], "left")
    x = x.withColumns({"prompt": F.coalesce("_p", "prompt"), "reliability": F.greatest("reliability", "_r")}).drop("_p", "_r")
    return x.unionByName(escalated.join(m.select("case_id", "set_id"), ["case_id", "set_id"], "left_anti"), allowMissingColumns=True), actions


def competing_objects(roots: DataFrame, others: DataFrame, parts: DataFrame, pairs: DataFrame, containment: float = 0.86, least_share: float = 0.01, most_share: float = 0.55, most_iou: float = 0.5, protect: float = 0.6, most_ratio: float = 2.5) -> DataFrame:
    """(case_id, root, set_id, protected, accepted): distinct roots that lie in a host root and so are taken out of it.

    roots: (case_id, set_id, name, hosts); others: (case_id, set_id, name, family); parts: (case_id, set_id, name,
    family, direct, confirmed), where a part of the host's name prefix from another family protects what it covers.
    """
    c = F.col
    h = roots.where("hosts").select("case_id", F.col("set_id").alias("x"), F.col("name").alias("host"))
    o = others.select("case_id", F.col("set_id").alias("y"), "name", "family")
    p = both_ways(pairs)
    cand = p.join(h, ["case_id", "x"]).join(o, ["case_id", "y"]).where(c("name") != c("host"))
    q = parts.select("case_id", F.col("set_id").alias("y"), F.col("name").alias("pn"), F.col("family").alias("pf"), (c("direct") | c("confirmed")).alias("own"))
    cover = p.select("case_id", F.col("x").alias("z"), "y", "inter", F.col("nx").alias("nz"), "area_coherence").join(q, ["case_id", "y"]).where(c("own") & (c("inter") / c("nz") >= protect) & (1 / c("area_coherence") <= most_ratio))
    kept = cand.select("case_id", "x", F.col("y").alias("z"), "host", "family").join(cover.drop("y"), ["case_id", "z"])
    kept = kept.where((c("pf") != c("family")) & c("pn").startswith(F.concat(c("host"), F.lit("_")))).select("case_id", "x", F.col("z").alias("y")).distinct().withColumn("protected", F.lit(True))
    x = cand.join(kept, ["case_id", "x", "y"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    ok = ~c("protected") & (c("inter") / c("ny") >= containment) & (c("inter") / c("nx")).between(least_share, most_share) & (c("iou") <= most_iou)
    return x.select("case_id", F.col("x").alias("root"), F.col("y").alias("set_id"), "protected", ok.alias("accepted"))


def corrected(candidates: DataFrame, updates: DataFrame, inventory: DataFrame) -> DataFrame:
    """``candidates`` after a root audit: (case_id, set_id, root, name, parent, is_root, visual, kind, token, place).

    updates: (case_id, root, domain). The first root row of an updated root takes the domain's name and the others go;
    visual children lose their name for a numbered one; other children stay only if the domain's inventory
    (domain, name) has their name.
    """
    c = F.col
    x = candidates.join(updates.select("case_id", "root", "domain"), ["case_id", "root"], "left").join(inventory.select("domain", "name").distinct().withColumn("_known", F.lit(True)), ["domain", "name"], "left")
    first = F.row_number().over(Window.partitionBy("case_id", "root", "is_root").orderBy("place"))
    n = F.row_number().over(Window.partitionBy("case_id", "root", "is_root", "visual").orderBy("place"))
    x = x.withColumn("_f", first).withColumn("_n", n)
    hit = c("domain").isNotNull()
    x = x.where(~hit | (c("is_root") & (c("_f") == 1)) | (~c("is_root") & (c("visual") | F.coalesce("_known", F.lit(False)))))
    slug = lambda v: F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "_"), F.lit("_"))
    named = F.format_string("%s_%s_audit_visual_%s_%02d", c("domain"), slug(c("token")), slug(F.coalesce("kind", F.lit("region"))), c("_n"))
    name = F.when(hit & c("is_root"), c("domain")).when(hit & c("visual"), named).otherwise(c("name"))
    parent = F.when(hit & (c("is_root") | c("visual")), c("domain")).otherwise(c("parent"))
    return x.select("case_id", "set_id", "root", name.alias("name"), parent.alias("parent"), (hit & c("visual") & ~c("is_root")).alias("reset"))


def evidence_scores(group: DataFrame) -> DataFrame:
    """``group`` (group, score, ...) with the score's min-max normal form in its group, one half where all are equal."""
    return group.withColumn("normal", min_max(F.col("score"), Window.partitionBy("group")))
