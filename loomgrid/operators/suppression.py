"""Greedy suppression, quotas and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .overlap import box_pairs


def greedy_suppression(items: DataFrame, conflicts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``items`` (item, place) with ``kept``: in order of place an item is kept unless it conflicts with a kept one.

    conflicts: (a, b) in either order. Each round settles every item whose earlier neighbours are settled, so the
    number of rounds is the longest chain of conflicts, not the number of items. Rounds go on until every item is
    settled; it raises if ``max_rounds`` are too few, or if conflicting items of one place wait for each other.
    """
    a = items.select(F.col("item").alias("a"), F.col("place").alias("pa"))
    b = items.select(F.col("item").alias("b"), F.col("place").alias("pb"))
    e = conflicts.select("a", "b").join(a, "a").join(b, "b").where("a <> b")
    first = F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b"))
    second = F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a"))
    edges = materialize(e.select(first.alias("first"), second.alias("item")).distinct(), "edges")
    # items without an earlier neighbour are kept at once
    new = materialize(items.select("item").join(edges.select("item").distinct(), "item", "left_anti").withColumn("kept", F.lit(True)), "settled")
    settled, rounds = new, 0
    while not edges.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"suppression did not settle in {max_rounds} rounds")
        rounds += 1
        # a round looks at what the last one settled and at the edges that are left
        x = edges.join(new.select(F.col("item").alias("first"), F.col("kept").alias("fk")), "first", "left")
        gone = materialize(x.where("fk").select("item").distinct(), "gone")
        left = materialize(x.where("fk IS NULL").select("first", "item").join(gone, "item", "left_anti"), "edges")
        free = edges.select("item").distinct().join(gone, "item", "left_anti").join(left.select("item").distinct(), "item", "left_anti")
        new = materialize(gone.withColumn("kept", F.lit(False)).unionByName(free.withColumn("kept", F.lit(True))), "settled")
        if new.isEmpty():
            raise ValueError("items of one place conflict both ways")
        settled, edges = settled.unionByName(new), left
        if rounds % 32 == 0:  # else the plan grows with the rounds
            settled = materialize(settled, "settled")
    return items.join(settled, "item", "left")


def resolved(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``items`` (item, place) with kept, and for those that go the kept item that comes first (``by``) and why.

    conflicts: (first, second, reason), where ``first`` has the earlier place; others don't count.
    """
    c = conflicts.select(F.col("first").alias("a"), F.col("second").alias("b"), "reason")
    out = materialize(greedy_suppression(items, c.select("a", "b")), "resolved")
    kept = out.where("kept").select(F.col("item").alias("a"), "place")
    by = c.join(kept, "a").groupBy(F.col("b").alias("item")).agg(F.min_by(F.struct(F.col("a").alias("by"), "reason"), "place").alias("x"))
    return out.join(by, "item", "left").select("item", "kept", F.when(~F.col("kept"), F.col("x.by")).alias("by"), F.when(~F.col("kept"), F.col("x.reason")).alias("reason"))


def box_nms(boxes: DataFrame, cell_x: float, cell_y: float, threshold: float, limit: int | None = None) -> DataFrame:
    """``boxes`` (case_id, box_id, x0, y0, x1, y1, score) that no kept box of higher score overlaps by ``threshold``;
    at most ``limit`` a case, best first (ties: smaller id)."""
    p = box_pairs(boxes, cell_x, cell_y).where(F.col("iou") >= threshold)
    items = boxes.select(F.col("box_id").alias("item"), F.struct((-F.col("score")).alias("s"), F.col("box_id").alias("b")).alias("place"))
    kept = greedy_suppression(items, p.select("a", "b")).where("kept").select(F.col("item").alias("box_id"))
    out = boxes.join(kept, "box_id", "left_semi")
    return quota(out, ["case_id"], [F.desc("score"), F.col("box_id")], limit) if limit is not None else out


def root_detections(boxes: DataFrame, cell_x: float, cell_y: float, threshold: float, limit: int) -> DataFrame:
    """Boxes (with a label) distinct across labels, dealt in turns over the labels; the places of a case go to turns in order."""
    return round_robin(box_nms(boxes, cell_x, cell_y, threshold), ["case_id"], ["label"], [F.desc("score"), F.col("box_id")], limit)


def child_detections(boxes: DataFrame, cell_x: float, cell_y: float, threshold: float, limit: int) -> DataFrame:
    """Boxes (with label, most and priority): distinct inside a label, at most ``most`` of each, dealt in turns of score
    times priority."""
    each = box_nms(boxes.withColumn("case_id", F.struct("case_id", "label")), cell_x, cell_y, threshold).withColumn("case_id", F.col("case_id.case_id"))
    best = [F.desc("score"), F.col("box_id")]
    capped = each.withColumn("_k", F.row_number().over(Window.partitionBy("case_id", "label").orderBy(*best))).where("_k <= most").drop("_k")
    return round_robin(capped, ["case_id"], ["label"], best, limit, [F.desc(F.col("score") * F.col("priority")), F.col("box_id")])


def quota(items: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def round_robin(items: DataFrame, scope: list[str], group: list[str], order: list[Column], limit: int, inside: list[Column] | None = None) -> DataFrame:
    """Rows in turns: every group's best, then every group's second, ... up to ``limit`` per scope. ``inside``: order of a turn's rows."""
    turn = F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*order))
    x = items.withColumn("turn", turn)
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy("turn", *(inside or order)))).where(F.col("_n") <= limit).drop("_n")


def instance_cap(groups: DataFrame, scope: list[str], cap: str, order: list[Column]) -> DataFrame:
    """Groups up to the smallest positive cap of their scope, strongest first; without a cap all stay."""
    least = F.min(F.when(F.col(cap) > 0, F.col(cap))).over(Window.partitionBy(*scope))
    x = groups.withColumn("_c", least).withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return x.where(F.col("_c").isNull() | (F.col("_n") <= F.col("_c"))).drop("_c", "_n")


def ambiguous_duplicates(items: DataFrame, conflicts: DataFrame, min_gap: float = 0.08) -> DataFrame:
    """``items`` (item, score, name, parent) that stay, with the names that ``collapsed`` into them (null if none).

    An item with its direct neighbours is a conflict set, not a component. If some member is the parent of all others
    the best such member stays and the others go; else a set whose two best scores are closer than ``min_gap`` goes as
    a whole; else the set says nothing.
    """
    both = conflicts.select("a", "b").union(conflicts.select("b", "a")).distinct().where("a <> b")
    sets = both.union(both.select("a", "a").distinct()).join(items.select(F.col("item").alias("b"), "score", "name", "parent"), "b")
    # a member is the parent of all others if as many members as there are others have its name as parent
    names = sets.groupBy("a", F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("below"))
    size = sets.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    m = sets.join(names, ["a", "name"], "left").join(size, "a")
    own = F.when(F.col("parent") == F.col("name"), 1).otherwise(0)
    m = materialize(m.withColumn("anchor", F.coalesce("below", F.lit(0)) - own == F.col("size") - 1), "conflict_sets")
    best = m.groupBy("a").agg(
        F.max_by(F.when(F.col("anchor"), F.col("b")), F.when(F.col("anchor"), F.struct("score", (-F.col("b")).alias("b")))).alias("anchor_id"),
        F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("top"),
    )
    close = F.get("top", 0) - F.get("top", 1) < min_gap
    m = m.drop("anchor").join(best, "a")
    goes = F.when(F.col("anchor_id").isNotNull(), F.col("b") != F.col("anchor_id")).otherwise(close)
    gone = m.where(goes).select(F.col("b").alias("item")).distinct()
    taken = m.where("b <> anchor_id").groupBy(F.col("anchor_id").alias("item")).agg(F.sort_array(F.collect_set("name")).alias("collapsed"))
    return items.join(gone, "item", "left_anti").join(taken, "item", "left")


def distinct_items(items: DataFrame, pairs: DataFrame, iou: float = 0.50, containment: float = 0.85) -> DataFrame:
    """``items`` (case_id, set_id, score) that no better kept one repeats, by overlap measures ``pairs``; ties go to the smaller id."""
    key = lambda s: F.struct("case_id", F.col(s).alias("set_id"))
    near = pairs.where((F.col("iou") >= iou) | (F.col("containment") >= containment)).select(key("a").alias("a"), key("b").alias("b"))
    order = items.select(key("set_id").alias("item"), F.struct((-F.col("score")).alias("s"), "case_id", "set_id").alias("place"))
    kept = greedy_suppression(order, near).where("kept").select("item.*")
    return items.join(kept, ["case_id", "set_id"], "left_semi")


def balanced(items: DataFrame, pairs: DataFrame, limits: dict[str, int], most: int, iou: float = 0.82) -> DataFrame:
    """Distinct ``items`` (case_id, set_id, score, size) with slots reserved by size: ``limits`` in order of preference, then the
    best of the rest, up to ``most`` a case."""
    x = distinct_items(items, pairs, iou, 2.0)
    best = [F.desc("score"), F.col("set_id")]
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("case_id", "size").orderBy(*best)))
    order = list(limits)
    most_of = F.coalesce(*(F.when(F.col("size") == s, n) for s, n in limits.items()), F.lit(0))
    place = F.coalesce(*(F.when(F.col("size") == s, k) for k, s in enumerate(order)), F.lit(len(order)))
    x = x.withColumn("_r", F.when(F.col("_k") <= most_of, place).otherwise(len(order)))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("_r", *best))
    return x.withColumn("_n", n).where(F.col("_n") <= most).drop("_k", "_r", "_n")


def pruned_envelopes(boxes: DataFrame, cell_x: float, cell_y: float, threshold: float = 0.68) -> DataFrame:
    """``boxes`` (case_id, box_id, x0, y0, x1, y1, envelope, quality, area) without envelopes that a better one (then the smaller) repeats."""
    e = boxes.where("envelope").select("case_id", "box_id", "x0", "y0", "x1", "y1", "quality", "area")
    p = box_pairs(e, cell_x, cell_y).where(F.col("iou") >= threshold)
    place = F.struct((-F.col("quality")).alias("q"), "area", "box_id")
    gone = greedy_suppression(e.select(F.col("box_id").alias("item"), place.alias("place")), p.select("a", "b")).where("NOT kept")
    return boxes.join(gone.select(F.col("item").alias("box_id")), "box_id", "left_anti")


def audit_budget(roots: DataFrame, limit: int, least: float = 2.0, minority: float = 0.12, natural: float = 0.5) -> DataFrame:
    """The roots of a case that most need a look: (case_id, root, priority), at most ``limit`` a case.

    roots: (case_id, root, name, score, evidence, global_domain, visual_domain, agreement, consensus, conflict,
    uncertain, unresolved, manmade). Each sign of doubt adds to the priority; roots below ``least`` are left out.
    Fixed values: the numbers below.
    """
    c, w = F.col, Window.partitionBy("case_id")
    n, same = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy("case_id", "name"))
    share = F.avg(c("name").isin("natural_object", "terrain").cast("double")).over(w)
    scene = (share >= natural) | ((F.max((c("name") == "terrain").cast("int")).over(w) > 0) & (share >= 0.25))
    add = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    known = add(c("global_domain") != c("name"), 3.0) + add(c("visual_domain") != c("name"), 2.0) + add(~c("agreement") & ~c("consensus"), 2.0) + add(c("conflict"), 2.0) + add(c("consensus"), -3.0)
    p = add(c("uncertain"), 5.0) + F.when(c("evidence"), known).otherwise(1.5 + add(c("unresolved"), 1.0)) + add(scene & c("manmade"), 4.0) + add(same / n <= minority, 1.0) + add((c("name") == "character") & ~c("uncertain") & ~c("conflict"), -5.0)
    x = roots.withColumn("priority", p).withColumn("_s", same).where(F.col("priority") >= least)
    k = F.row_number().over(w.orderBy(F.desc("priority"), "_s", F.desc("score"), "root"))
    return x.withColumn("_k", k).where(F.col("_k") <= limit).select("case_id", "root", "priority")


def suspicion(score: Column, share: Column, most_share: Column, confirmed: Column) -> Column:
    """How much a part's name needs a look. The numbers."""
    clip = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), F.lit(hi))
    return 1.0 - clip(score, 1.0) + 0.45 * clip(share / F.greatest(most_share, F.lit(1e-6)), 1.5) + F.when(confirmed, 0.0).otherwise(0.08)
