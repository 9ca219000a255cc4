"""Evaluation of label maps, requests, occlusion and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, iou, precision, recall) of label maps (case_id, e, label) over all cases; a label that neither has is absent."""
    x = predicted.withColumnRenamed("label", "p").join(truth.withColumnRenamed("label", "t"), ["case_id", "e"], "full")
    c = x.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    both = c.select("n", F.explode(F.array_distinct(F.array("p", "t"))).alias("label"), "p", "t").where("label IS NOT NULL")
    is_ = lambda s: F.coalesce(F.col(s) == F.col("label"), F.lit(False))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = both.groupBy("label").agg(n(is_("p") & is_("t")).alias("i"), n(is_("p")).alias("np"), n(is_("t")).alias("nt"))
    return g.select("label", (F.col("i") / (F.col("np") + F.col("nt") - F.col("i"))).alias("iou"), (F.col("i") / F.greatest("np", F.lit(1))).alias("precision"), (F.col("i") / F.greatest("nt", F.lit(1))).alias("recall"))


def resolution_states(options: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, state, correct) of requests (request, target) with their options (request, item): unique, ambiguous or unresolved."""
    o = options.groupBy("request").agg(F.countDistinct("item").alias("n"), F.min("item").alias("only"))
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous")
    return requests.join(o, "request", "left").select("request", state.alias("state"), ((n == 1) & F.coalesce(F.col("only") == F.col("target"), F.lit(False))).alias("correct"))


def occlusion(counts: DataFrame) -> DataFrame:
    """Completion metrics from set sizes (case_id, visible, full, completed, both_full, added_hidden, kept_visible).

    both_full: completed and truly there; added_hidden: added and truly hidden; kept_visible: visible and still there.
    A measure over an empty set is 1.
    """
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    v, f, c, bf, ah, kv = (F.col(k) for k in ("visible", "full", "completed", "both_full", "added_hidden", "kept_visible"))
    added = c - kv
    return counts.select("case_id", share(v, f).alias("iou_before"), share(bf, f + c - bf).alias("iou_after"), share(ah, f - v).alias("hidden_recall"), share(ah, added).alias("added_precision"), (1 - share(ah, added)).alias("false_added"), share(kv, v).alias("visible_recall"))


def identity_audit(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per case: repeated part ids, parents that aren't there, groups without a member, members without a part.

    parts: (case_id, part_id, parent_id, group_id); groups: (case_id, group_id, member_id).
    """
    p = parts.groupBy("case_id").agg((F.count("part_id") - F.countDistinct("part_id")).alias("duplicate_ids"))
    ids = parts.select("case_id", "part_id").distinct()
    lost = parts.where("parent_id IS NOT NULL").join(ids.withColumnRenamed("part_id", "parent_id"), ["case_id", "parent_id"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("invalid_parents"))
    used = parts.where("group_id IS NOT NULL").join(groups.select("case_id", "group_id").distinct(), ["case_id", "group_id"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("unresolved_groups"))
    member = groups.join(ids.withColumnRenamed("part_id", "member_id"), ["case_id", "member_id"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("invalid_members"))
    for x in (lost, used, member):
        p = p.join(x, "case_id", "left")
    return p.na.fill(0)


def signed_ranks(deltas: DataFrame, key: str, delta: str) -> DataFrame:
    """(key, n, w_plus, w_minus, effect, z, p): signed-rank sums of paired differences, ties at mean ranks.

    Zero differences are ranked and split between both sums; z is the sums' normal approximation, with the variance of
    all ranks, and p its two-sided p-value. Ranks come from value counts.
    """
    from .stats import normal_p

    c = deltas.where(F.col(delta).isNotNull()).groupBy(key, F.abs(delta).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("plus"), F.count_if(F.col(delta) < 0).alias("minus"))
    r = F.sum("n").over(Window.partitionBy(key).orderBy("m")) - (F.col("n") - 1) / 2.0
    zero = F.col("n") - F.col("plus") - F.col("minus")
    side = lambda s: F.sum((F.col(s) + zero / 2) * F.col("r"))
    g = c.withColumn("r", r).groupBy(key).agg(F.sum("n").alias("n"), side("plus").alias("w_plus"), side("minus").alias("w_minus"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("squares"))
    g = g.withColumn("effect", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))
    g = g.withColumn("z", F.when(F.col("squares") > 0, (F.col("w_plus") - F.col("w_minus")) / F.sqrt("squares")).otherwise(0.0))
    return g.withColumn("p", normal_p(F.col("z"))).drop("squares")


def probability_thresholds(rows: DataFrame, p: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, iou, false_share) of a probability cut at several thresholds, in one pass over the rows."""
    x = rows.select(F.col(p).alias("_p"), truth.alias("_t"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("_p") >= F.col("threshold")
    g = x.groupBy("threshold").agg(F.count_if(hit & F.col("_t")).alias("i"), F.count_if(hit | F.col("_t")).alias("u"), F.count_if(hit & ~F.col("_t")).alias("f"), F.count(F.lit(1)).alias("n"))
    return g.select("threshold", (F.col("i") / F.greatest("u", F.lit(1))).alias("iou"), (F.col("f") / F.col("n")).alias("false_share"))


def threshold_selection(rows: DataFrame, p: str, truth: Column, thresholds: list[float], penalty: float = 0.35) -> DataFrame:
    """``probability_thresholds`` with score (IoU less ``penalty`` times the false share) and the chosen threshold: best score, ties to the smaller one."""
    x = probability_thresholds(rows, p, truth, thresholds).withColumn("score", F.col("iou") - penalty * F.col("false_share"))
    best = x.agg(F.max_by("threshold", F.struct("score", (-F.col("threshold")).alias("t"))).alias("_b"))  # one row
    return x.join(F.broadcast(best)).withColumn("chosen", F.col("threshold") == F.col("_b")).drop("_b")


def semantic_unions(predicted: DataFrame, truth: DataFrame, least_iou: float = 0.25) -> DataFrame:
    """(case_id, recall, precision, mean_iou) by name: unions of predicted and true sets (case_id, name, e) of each true name.

    recall: true names whose union IoU reaches ``least_iou``; precision: share of predicted names that are true ones.
    """
    p, t = (x.select("case_id", "name", "e").distinct().withColumn(k, F.lit(1)) for x, k in ((predicted, "_p"), (truth, "_t")))
    g = p.join(t, ["case_id", "name", "e"], "full").groupBy("case_id", "name").agg(F.count("_p").alias("np"), F.count("_t").alias("nt"), F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("i"))
    iou = F.col("i") / (F.col("np") + F.col("nt") - F.col("i"))
    true = F.col("nt") > 0
    g = g.groupBy("case_id").agg(F.count_if(true).alias("names"), F.count_if(true & (iou >= least_iou)).alias("hits"), F.count_if(F.col("np") > 0).alias("predicted"), F.count_if(true & (F.col("np") > 0)).alias("both"), F.avg(F.when(true, iou)).alias("mean_iou"))
    return g.select("case_id", (F.col("hits") / F.greatest("names", F.lit(1))).alias("recall"), (F.col("both") / F.greatest("predicted", F.lit(1))).alias("precision"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def macro_average(rows: DataFrame, ok: Column, metrics: list[str], flags: list[str]) -> DataFrame:
    """One row: cases, successes, means of ``metrics`` over successes (0 without any), and shares of true ``flags`` among those that have one."""
    share = lambda f: F.coalesce(F.avg(F.when(ok & F.col(f).isNotNull(), F.col(f).cast("double"))), F.lit(0.0)).alias(f)
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("successes"), *(F.coalesce(F.avg(F.when(ok, F.col(m).cast("double"))), F.lit(0.0)).alias(m) for m in metrics), *(share(f) for f in flags))


def failure_class(domain_correct: Column, object_iou: Column, part_f1: Column, semantic_recall: Column) -> Column:
    """The first stage that failed. The limits."""
    from .validation import ladder

    return ladder([("routing_error", ~F.coalesce(domain_correct, F.lit(False))), ("root_failure", object_iou < 0.25), ("weak_root", object_iou < 0.50), ("part_discovery_failure", part_f1 < 0.10), ("semantic_assignment_failure", semantic_recall < 0.10)], "partial_or_strong_success")


def ablation(candidates: DataFrame, variants: dict[str, dict[str, Column]]) -> DataFrame:
    """``candidates`` once for each variant, with the columns that it sets; variants are a few rows and are never joined."""
    names = sorted({c for v in variants.values() for c in v})
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), *(v[c].alias(c) for c in names)) for k, v in variants.items())))
    return candidates.drop(*names).withColumn("_v", rows).select(*(c for c in candidates.columns if c not in names), "_v.*")


def sensitivity(parameters: dict[str, float], factors: list[float]) -> list[dict]:
    """One-factor grid: each parameter times each factor, the others at their base."""
    return [{"variant": f"{p}__{f:.1f}x", "parameter": p, "factor": f, "values": {**parameters, p: v * f}} for p, v in parameters.items() for f in factors]


def component_support(overlaps: DataFrame, least: float = 0.35) -> DataFrame:
    """(case_id, component, supported, names) by the candidates that cover enough of a component.

    overlaps: (case_id, component, area, set_id, family, name, semantic, inter). Two families, or one semantic
    candidate, support it.
    """
    x = overlaps.withColumn("_h", F.col("inter") / F.greatest("area", F.lit(1)) >= least)
    g = x.groupBy("case_id", "component").agg(F.countDistinct(F.when(F.col("_h"), F.col("family"))).alias("f"), F.max(F.col("_h") & F.col("semantic")).alias("s"), F.sort_array(F.collect_set(F.when(F.col("_h"), F.col("name")))).alias("names"))
    return g.select("case_id", "component", (F.coalesce("s", F.lit(False)) | (F.col("f") >= 2)).alias("supported"), "names")


def consensus_seed(members: DataFrame, clusters: DataFrame, elem: DataFrame, roots: DataFrame) -> DataFrame:
    """(case_id, cluster, members, area, score, selected): the cluster of masks that most routes confirm.

    members: (case_id, set_id, confidence); clusters: (case_id, set_id, cluster); roots: (case_id, area). score:
    3 a member, plus the best confidence, plus twice the root of the share of the root that their union covers
    (fixed values); ties go to the smaller cluster.
    """
    x = members.join(clusters, ["case_id", "set_id"])
    union = elem.join(clusters, ["case_id", "set_id"]).select("case_id", "cluster", "e").distinct().groupBy("case_id", "cluster").agg(F.count(F.lit(1)).alias("area"))
    g = x.groupBy("case_id", "cluster").agg(F.count(F.lit(1)).alias("members"), F.max("confidence").alias("_c")).join(union, ["case_id", "cluster"]).join(roots.select("case_id", F.col("area").alias("_r")), "case_id")
    g = g.withColumn("score", 3.0 * F.col("members") + F.col("_c") + 2.0 * F.sqrt(F.col("area") / F.greatest("_r", F.lit(1))))
    first = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "cluster"))
    return g.withColumn("selected", first == 1).drop("_c", "_r")


def stratified_holdout(rows: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """``rows`` with ``holdout``: of each stratum a share of its rows, at least one, those of smallest hash fraction."""
    from ..functions.scores import hash_fraction

    w = Window.partitionBy(stratum)
    x = rows.withColumn("_h", hash_fraction(F.col(key), seed))
    n, size = F.row_number().over(w.orderBy("_h", key)), F.count(F.lit(1)).over(w)
    return x.withColumn("_n", n).withColumn("holdout", F.col("_n") <= F.greatest(F.lit(1), F.bround(size * share))).drop("_h", "_n")
