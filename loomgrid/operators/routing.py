"""Routing of names, domains and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_phrase


def resolve_prompts(prompts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(prompt, label, domain, score, resolved) of normalized prompts against aliases (alias, label, domain).

    An equal alias scores 1, a contained one .84 plus .08 of its share of the prompt's tokens. The best by score,
    then tokens, then label wins; it is resolved if all rows of that score name one domain.
    """
    n = lambda c: F.size(F.split(c, " "))
    p = prompts.select("prompt").distinct().withColumn("t", F.explode(F.array_distinct(F.split("prompt", " "))))
    a = aliases.select("alias", "label", "domain").distinct().withColumn("t", F.explode(F.array_distinct(F.split("alias", " "))))
    x = p.join(a, "t").drop("t").distinct().where(contains_phrase(F.col("prompt"), F.col("alias")))
    score = F.when(F.col("prompt") == F.col("alias"), 1.0).otherwise(0.84 + 0.08 * n("alias") / n("prompt"))
    w = Window.partitionBy("prompt")
    x = x.withColumn("score", score).withColumn("top", F.max("score").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), F.desc(n("alias")), F.desc("label"))))
    best = x.where("score = top").groupBy("prompt").agg((F.countDistinct("domain") == 1).alias("resolved"))
    return x.where("k = 1").join(best, "prompt").select("prompt", "label", "domain", "score", "resolved")


def domain_votes(candidates: DataFrame, near: float = 0.02, least_share: float = 0.6) -> DataFrame:
    """(case_id, domain, kept) from ambiguous candidates (case_id, domain, score, current).

    The current domain stays if its best score is within ``near`` of the top; else the domain of most candidates
    (then score sum, best score, name) needs its share of the votes.
    """
    w = Window.partitionBy("case_id")
    g = candidates.groupBy("case_id", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.max("score").alias("best"), F.first("current").alias("current"))
    g = g.withColumn("top", F.max("best").over(w)).withColumn("all", F.sum("n").over(w))
    stays = F.max(F.when((F.col("domain") == F.col("current")) & (F.col("best") >= F.col("top") - near), 1).otherwise(0)).over(w)
    g = g.withColumn("stays", stays).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), F.desc("s"), F.desc("best"), "domain"))).where("k = 1")
    wins = F.col("n") / F.col("all") >= least_share
    return g.select("case_id", F.when(F.col("stays") == 1, F.col("current")).when(wins, F.col("domain")).otherwise(F.col("current")).alias("domain"), ((F.col("stays") == 1) | ~wins).alias("kept"))


def cross_view(full: DataFrame, crop: DataFrame, near: float = 0.015, least: float = 0.0, lenient: DataFrame | None = None) -> DataFrame:
    """(case_id, label, score, margin) where two views (case_id, label, score) agree on the full view's first label.

    In the crop it must be first or within ``near`` of the first; with ``lenient`` (case_id), only those cases, whose
    root is the first global proposal, may be near. The score is the mean of both, the margin its lead over the best
    other label's mean.
    """
    w = Window.partitionBy("case_id")
    f = full.withColumn("kf", F.row_number().over(w.orderBy(F.desc("score"), "label"))).withColumnRenamed("score", "sf")
    c = crop.withColumn("top", F.max("score").over(w)).withColumnRenamed("score", "sc")
    x = f.join(c, ["case_id", "label"]).withColumn("score", (F.col("sf") + F.col("sc")) / 2)
    others = F.max(F.when(F.col("kf") > 1, F.col("score"))).over(w)
    x = x.withColumn("margin", F.col("score") - F.coalesce(others, F.lit(0.0))).where("kf = 1")
    slack = F.lit(near)
    if lenient is not None:
        x = x.join(lenient.select("case_id").distinct().withColumn("_l", F.lit(True)), "case_id", "left")
        slack = F.when(F.col("_l"), near).otherwise(0.0)
    return x.where((F.col("sc") >= F.col("top") - slack) & (F.least("sf", "sc") >= least)).select("case_id", "label", "score", "margin")


def domain_prior(alternatives: DataFrame, least_score: float, least_margin: float, least_share: float = 0.8, most: int = 5) -> DataFrame:
    """(case_id, domain, support, accepted, reason) of full-image routes (case_id, rank, domain, score, margin, accepted).

    Of the first ``most`` alternatives with a domain the first names it. An accepted route of that domain is taken;
    else its score, margin and the share of alternatives of its domain must all be large enough.
    """
    w = Window.partitionBy("case_id")
    x = alternatives.where((F.col("rank") <= most) & (F.trim(F.coalesce("domain", F.lit(""))) != ""))
    first = F.first("domain").over(w.orderBy("rank"))
    x = x.withColumn("_d", first).withColumn("_n", F.row_number().over(w.orderBy("rank")))
    g = x.groupBy("case_id").agg(F.first("_d").alias("domain"), F.avg((F.col("domain") == F.col("_d")).cast("double")).alias("support"), *(F.max(F.when(F.col("_n") == 1, F.col(k))).alias(k) for k in ("score", "margin", "accepted")))
    near = (F.col("score") >= least_score) & (F.col("margin") >= least_margin) & (F.col("support") >= least_share)
    why = F.when(F.col("accepted"), "accepted_exact_full_image_domain").when(near, "accepted_near_threshold_domain_consensus").otherwise("insufficient_full_image_domain_evidence")
    return g.select("case_id", F.when(F.col("accepted") | near, F.col("domain")).alias("domain"), "support", (F.col("accepted") | near).alias("accepted"), why.alias("reason"))
