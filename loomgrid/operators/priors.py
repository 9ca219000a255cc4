"""Priors of part names, from reviewed examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mode(rows: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """(keys, value): the most frequent value of each key; ties go to the one seen first."""
    c = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.min(place).alias("_p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), "_p")
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, value)


def part_priors(examples: DataFrame, floor: float = 0.04) -> DataFrame:
    """Per name: prevalence (weight of the assets that have it), support, instance limit and geometry of examples
    (asset, weight, name, geometry array<double>). The limit is the ninth decile of instances per asset."""
    total = examples.select("asset", "weight").distinct().agg(F.sum("weight").alias("_total"))  # one row
    per = examples.groupBy("name", "asset").agg(F.max("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    a = per.groupBy("name").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("support"), F.ceil(F.percentile("n", F.lit(0.9))).cast("int").alias("maximum_instances"))
    g = examples.select("name", F.posexplode("geometry").alias("k", "x")).groupBy("name", "k").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
    g = g.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("g"))
    x = a.join(g, "name").join(F.broadcast(total))
    return x.select("name", (F.col("w") / F.col("_total")).alias("prevalence"), "support", "maximum_instances", F.transform("g", lambda v: v["m"]).alias("geometry_mean"), F.transform("g", lambda v: v["s"]).alias("geometry_std"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Priors (name, prevalence, support, samples) of two sources: larger statistics, samples in order without repeats."""
    b = second.withColumnsRenamed({c: f"_{c}" for c in ("prevalence", "support", "samples")})
    none = F.array().cast(dict(first.dtypes)["samples"])
    return first.join(b, "name", "full").select("name", F.greatest("prevalence", "_prevalence").alias("prevalence"), F.greatest("support", "_support").alias("support"), F.array_distinct(F.concat(F.coalesce("samples", none), F.coalesce("_samples", none))).alias("samples"))


def compatibility(geometry: Column, samples: Column, spread: Column) -> Column:
    """Gaussian of the least mean squared deviation from any sample, or from it mirrored in x (first component)."""

    def one(g: Column) -> Column:
        z = lambda s: F.aggregate(F.zip_with(F.zip_with(g, s, lambda a, b: a - b), spread, lambda d, v: (d / v) * (d / v)), F.lit(0.0), lambda a, b: a + b) / F.size(g)
        return F.exp(-0.5 * F.array_min(F.transform(samples, z)))

    mirrored = F.transform(geometry, lambda x, k: F.when(k == 0, 1.0 - x).otherwise(x))
    return F.greatest(one(geometry), one(mirrored))


def frequency_weights(rows: DataFrame, name: str) -> DataFrame:
    """(name, weight): inverse square root of the frequency, with mean 1 over rows."""
    c = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    mean = c.agg((F.sum(F.col("n") / F.sqrt("n")) / F.sum("n")).alias("_m"))  # one row
    return c.join(F.broadcast(mean)).select(name, (1 / F.sqrt("n") / F.col("_m")).alias("weight"))
