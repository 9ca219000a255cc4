"""Evaluation statistics: intervals, tests, confusion, tiers, paired deltas."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """(low, high) of a binomial share; nulls if n is 0."""
    p, n_ = hits / n, n.cast("double")
    mid, half, by = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)), 1 + z * z / n_
    return F.when(n > 0, F.struct(((mid - half) / by).alias("low"), ((mid + half) / by).alias("high")))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of b against c discordant pairs, for any counts."""
    n, k = b + c, min(b, c)
    # the tail's terms over its largest one, which stands last; terms too small to change the sum end it
    term, terms = 1.0, 0.0
    while k >= 0 and term > terms * 1e-18:
        terms += term
        term *= k / (n - k + 1)
        k -= 1
    k = min(b, c)
    tail = math.log(terms) + math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * math.exp(min(tail, 0.0)))


def confusion(rows: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Counts, precision, recall, F1 and review rate per key."""
    n = lambda c: F.count_if(c)
    x = rows.groupBy(*keys).agg(n(predicted & truth).alias("tp"), n(predicted & ~truth).alias("fp"), n(~predicted & truth).alias("fn"), n(~predicted & ~truth).alias("tn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return x.withColumns({"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-12)), "review_rate": (F.col("tp") + F.col("fp")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))})


def mean_ranks(rows: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """(value, n, rank): each value's number of rows and mean rank among all rows.

    Values are counted, dealt into ``parts`` ranges (the session's shuffle partitions) and summed by range first; each
    task then orders one range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id()), "counts")
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    before = n.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("before"))
    here = F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return n.join(F.broadcast(before), "part").select(value, "n", (F.col("before") + here - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, with mean ranks for ties, the number of pairs, and the two-sided p-value of rho by Student's t with
    n - 2 degrees of freedom; rho 0 and p 1 if one side is constant. Hot values cost one row."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        both = both.join(mean_ranks(both, c).select(c, F.col("rank").alias(f"_{c}")), c)
    spread = F.stddev_pop(f"_{x}") * F.stddev_pop(f"_{y}")
    rho = both.agg(F.when(spread > 0, F.covar_pop(f"_{x}", f"_{y}") / spread).otherwise(0.0).alias("rho"), F.count(F.lit(1)).alias("n"))
    return rho.withColumn("p", student_p("rho", "n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation of ``n`` pairs by Student's t; 1 if it is 0 or there are fewer than 3 pairs."""
    if n < 3 or not rho:
        return 1.0
    # t has n - 2 degrees of freedom, and (n - 2) / (n - 2 + t t) is 1 - rho rho
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - rho * rho))


def student_p(rho: str, n: str) -> Column:
    """``correlation_p`` of two columns of a few rows."""
    return F.udf(lambda r, k: correlation_p(r, k), "double")(rho, n)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal ``z``, of a few rows."""
    return F.udf(lambda v: None if v is None else math.erfc(abs(v) / math.sqrt(2)), "double")(z)


def paired_delta(rows: DataFrame, case: str, variant: str, value: str, reference: str, variants: list[str]) -> DataFrame:
    """(case, variant, delta): each variant's value less the reference's, over cases that have both."""
    wide = rows.groupBy(case).pivot(variant, [reference, *variants]).agg(F.first(value))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), (F.col(f"`{v}`") - F.col(f"`{reference}`")).alias("delta")) for v in variants)))
    return wide.select(case, each.alias("_")).select(case, "_.*").where("delta IS NOT NULL")


#: Resampled units of a block, and blocks of a stratum at most.
BLOCK_UNITS, MAX_BLOCKS = 4096, 4096


def _resampled(units: DataFrame, draws: int, seed: int, level: float) -> DataFrame:
    """Per stratum: mean, percentile interval and number of ``units`` (stratum, x, w, n) drawn with replacement.

    n equal units have sum x and weight w each; a draw's mean is the sum of x over that of w, and draws without weight
    are left out. Units fall into blocks by hash; a draw is first dealt out to a stratum's blocks and then inside each
    block, which is the same multinomial law, so no task holds more than a block.
    """
    units = materialize(units, "units")
    kind = dict(units.dtypes)["stratum"]
    size = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    blocks = max(1, min(MAX_BLOCKS, -(-size // BLOCK_UNITS)))
    units = units.withColumn("block", F.pmod(F.xxhash64("x", "w"), F.lit(blocks)).cast("int"))
    rng = lambda *of: np.random.default_rng([seed, *(zlib.crc32(repr(k).encode()) for k in of)])

    def deal(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("block")
        n = t["n"].to_numpy()
        dealt = rng(t["stratum"].iloc[0]).multinomial(int(n.sum()), n / n.sum(), draws)
        return pd.DataFrame({"stratum": t["stratum"], "block": t["block"], "taken": list(dealt.T)})

    def draw(u: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(["x", "w"])
        x, w, p = u["x"].to_numpy(float), u["w"].to_numpy(float), u["n"].to_numpy() / u["n"].sum()
        r = rng(u["stratum"].iloc[0], int(u["block"].iloc[0]))
        sums = [(m @ x, m @ w) for m in (r.multinomial(int(k), p) for k in d["taken"].iloc[0])]
        out = pd.DataFrame(sums, columns=["x", "w"]).assign(draw=range(len(sums)))
        return out.assign(stratum=u["stratum"].iloc[0])[["stratum", "draw", "x", "w"]]

    counts = units.groupBy("stratum", "block").agg(F.sum("n").alias("n"))
    dealt = counts.groupBy("stratum").applyInPandas(deal, f"stratum {kind}, block int, taken array<long>")
    sums = units.groupBy("stratum", "block").cogroup(dealt.groupBy("stratum", "block")).applyInPandas(draw, f"stratum {kind}, draw int, x double, w double")
    means = sums.groupBy("stratum", "draw").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).where("w > 0").withColumn("m", F.col("x") / F.col("w"))
    ends = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    whole = units.groupBy("stratum").agg((F.sum(F.col("n") * F.col("x")) / F.sum(F.col("n") * F.col("w"))).alias("mean"), F.sum("n").alias("units"))
    return whole.join(means.groupBy("stratum").agg(ends.alias("e")), "stratum").select("stratum", "mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "units")


def bootstrap(values: DataFrame, value: str, draws: int = 2000, seed: int = 7, level: float = 0.95, stratum: str | None = None) -> DataFrame:
    """Percentile interval of the mean, per stratum, when cases are drawn with replacement. Equal values are one row."""
    v = values.select((F.col(stratum) if stratum else F.lit(0)).alias("stratum"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    v = v.groupBy("stratum", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.lit(1.0))
    x = _resampled(v, draws, seed, level).withColumnRenamed("units", "cases")
    return x.withColumnRenamed("stratum", stratum) if stratum else x.drop("stratum")


def cluster_bootstrap(values: DataFrame, cluster: str, value: str, draws: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of the case mean when whole clusters are drawn with replacement; draws without a case are left out."""
    g = values.groupBy(cluster).agg(F.sum(value).cast("double").alias("x"), F.count(value).cast("double").alias("w"))
    g = g.select(F.lit(0).alias("stratum"), F.coalesce("x", F.lit(0.0)).alias("x"), "w").groupBy("stratum", "x", "w").agg(F.count(F.lit(1)).alias("n"))
    return _resampled(g, draws, seed, level).select("mean", "low", "high", F.col("units").alias("clusters"))


def reliability_bins(rows: DataFrame, weight: str, hit: Column) -> DataFrame:
    """Ten equal bins of a weight in [0, 1]: rows, mean weight, hit rate, Brier score and share of the calibration error."""
    b = F.least(F.floor(F.col(weight) * 10), F.lit(9)).cast("int")
    h = hit.cast("double")
    x = rows.withColumn("_h", h).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(weight).alias("mean_weight"), F.avg("_h").alias("hit_rate"), F.avg((F.col(weight) - F.col("_h")) ** 2).alias("brier"))
    return x.withColumn("error", F.abs(F.col("mean_weight") - F.col("hit_rate")) * F.col("n"))


def coverage_tiers(rows: DataFrame, policies: dict[str, Column], failed: Column, value: str) -> DataFrame:
    """(policy, coverage, failure_rate, mean) of the rows each acceptance policy takes; one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("taken")) for n, c in policies.items())))
    x = rows.select(failed.alias("_f"), F.col(value).alias("_v"), each.alias("_p"))
    taken = F.col("_p.taken")
    return x.groupBy("_p.policy").agg(F.avg(taken.cast("double")).alias("coverage"), F.avg(F.when(taken, F.col("_f").cast("double"))).alias("failure_rate"), F.avg(F.when(taken, F.col("_v"))).alias("mean"))


def select_rules(rows: DataFrame, rules: dict[str, Column], truth: Column, most: int = 2, least_gain: float = 0.02) -> list[str]:
    """Greedy forward choice of rules whose disjunction predicts ``truth``: by F1, then smaller review rate, then name."""
    fired = rows.select(truth.cast("int").alias("t"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()))
    g = fired.groupBy("t", *rules).count().collect()  # at most 2 ** (rules + 1) rows
    if len(rules) > 16:
        raise ValueError("at most 16 rules")

    def rate(chosen: list[str]) -> tuple[float, float]:
        hit = lambda r: any(r[n] for n in chosen)
        tp = sum(r["count"] for r in g if hit(r) and r["t"])
        got, all_, true = sum(r["count"] for r in g if hit(r)), sum(r["count"] for r in g), sum(r["count"] for r in g if r["t"])
        return (2 * tp / max(1, got + true), got / max(1, all_))

    chosen: list[str] = []
    while len(chosen) < most:
        now = rate(chosen)[0] if chosen else 0.0
        options = sorted(((-rate([*chosen, n])[0], rate([*chosen, n])[1], n) for n in rules if n not in chosen))
        if not options or -options[0][0] - now < least_gain:
            break
        chosen.append(options[0][2])
    return chosen
