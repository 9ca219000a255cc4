"""Parents of sets: nearest, enclosing, attached remainders, excluded ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .graph import descendants

#: Records of a block; a pair of blocks is made at once. Pairs of a task.
BLOCK, PAIRS = 2_000, 20_000_000


def best_parent(pairs: DataFrame, least_overlap: float = 0.02, most_distance: float = 0.25) -> DataFrame:
    """(case_id, child, parent) from pairs (case_id, child, parent, tier, overlap, distance, support).

    Only pairs of the child's best (smallest) tier compete: by overlap, then distance, then support, then parent. A
    winner that neither overlaps nor lies near is dropped.
    """
    top = F.min("tier").over(Window.partitionBy("case_id", "child"))
    order = Window.partitionBy("case_id", "child").orderBy(F.desc("overlap"), "distance", F.desc("support"), "parent")
    x = pairs.withColumn("_t", top).where("tier = _t").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return x.where((F.col("overlap") >= least_overlap) | (F.col("distance") <= most_distance)).select("case_id", "child", "parent")


def enclosing(pairs: DataFrame, least_containment: float = 0.9, most_share: float = 0.72) -> DataFrame:
    """(case_id, child, parent, depth) from overlap measures: the smallest set that encloses another, clearly larger one.

    depth is 1 below a set without a parent, else 2.
    """
    big = F.col("na") >= F.col("nb")
    x = pairs.where((F.col("containment") >= least_containment) & (F.least("na", "nb") <= most_share * F.greatest("na", "nb")))
    x = x.select("case_id", F.when(big, F.col("b")).otherwise(F.col("a")).alias("child"), F.when(big, F.col("a")).otherwise(F.col("b")).alias("parent"), F.greatest("na", "nb").alias("n"))
    w = Window.partitionBy("case_id", "child").orderBy("n", "parent")
    p = x.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("case_id", "child", "parent")
    up = p.select("case_id", F.col("child").alias("parent"), F.lit(2).alias("_d"))
    return p.join(up, ["case_id", "parent"], "left").select("case_id", "child", "parent", F.coalesce("_d", F.lit(1)).alias("depth"))


def attach(pieces: DataFrame, most_distance: float) -> DataFrame:
    """(case_id, piece, owner) from candidates (case_id, piece, owner, overlap, distance): greatest overlap if any, else the nearest within reach, else null."""
    order = Window.partitionBy("case_id", "piece").orderBy(F.desc("overlap"), "distance", "owner")
    x = pieces.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return x.select("case_id", "piece", F.when((F.col("overlap") > 0) | (F.col("distance") <= most_distance), F.col("owner")).alias("owner"))


def non_occluders(records: DataFrame, links: DataFrame) -> DataFrame:
    """(item, other) of records (item, semantic, assembly_parent) that can't hide an item: itself, records of an ancestor semantic, its assembly parent.

    links: (semantic, parent); the first parent by name counts; cycles stop.
    """
    one = links.groupBy("semantic").agg(F.min("parent").alias("parent"))
    up = descendants(one.select("parent", F.col("semantic").alias("child")), on_cycle="stop").select(F.col("descendant").alias("semantic"), F.col("ancestor").alias("above"))
    x = materialize(records.select("item", "semantic").distinct(), "records", compact=True)
    blocks = x.groupBy("semantic").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    side = lambda s: blocks.select(F.col("semantic").alias(s), F.col("n").alias(f"n_{s}"), F.col("blocks").alias(f"b_{s}"))
    up = materialize(up.join(side("semantic"), "semantic").join(side("above"), "above"), "semantics", compact=True)
    pairs = up.agg(F.coalesce(F.sum(F.col("n_semantic") * F.col("n_above")), F.lit(0))).first()[0]
    parts = max(records.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS)
    # both sides are dealt to blocks, so the pairs are made where blocks meet and aren't shuffled
    keys, block = ["semantic", "above", "i", "j"], lambda c, n: F.pmod(F.xxhash64(c), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = x.join(up, "semantic").select("item", "semantic", "above", block("item", F.col("b_semantic")).alias("i"), all_of("b_above").alias("j")).repartition(parts, *keys)
    other = x.select(F.col("item").alias("other"), F.col("semantic").alias("above"))
    right = other.join(up, "above").select("other", "semantic", "above", all_of("b_semantic").alias("i"), block("other", F.col("b_above")).alias("j")).repartition(parts, *keys)
    above = left.join(right, keys).select("item", "other")
    own = records.select("item", F.col("item").alias("other")).distinct()
    assembled = records.where("assembly_parent IS NOT NULL AND NOT item <=> assembly_parent").select("item", "semantic", F.col("assembly_parent").alias("other")).distinct()
    assembled = assembled.join(other, "other", "left").join(up, ["semantic", "above"], "left_anti").select("item", "other")
    if not x.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # else no pair comes twice
        return above.unionByName(own).unionByName(assembled).distinct()
    return above.unionByName(own).unionByName(assembled)
