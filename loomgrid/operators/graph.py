"""Graph operators over edge tables: components, descendants, depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (columns a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps: two shuffles a round, O(log n) rounds, nothing collected but a
    count and a checksum.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", compact=True)
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(large.join(least, "u").select(F.explode(pairs).alias("x")).select("x.*").where("u <> v").distinct(), "edges", compact=True)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def descendants(links: DataFrame, max_depth: int = 64, on_cycle: str = "raise") -> DataFrame:
    """(ancestor, descendant, depth) of every pair below one another in ``links`` (parent, child).

    Level k holds the distinct pairs that k links join, so shared children don't multiply; depth is the longest path.
    on_cycle: "raise", or "stop", which goes on from new pairs only and gives the shortest path.
    """
    step = materialize(links.select("parent", "child").distinct(), "links")
    level = step.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"))
    done = None
    for depth in range(1, max_depth + 2):
        level = level.where("ancestor <> descendant") if on_cycle == "stop" else level
        if on_cycle == "stop" and done is not None:
            level = level.join(done.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti")
        level = materialize(level.withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        if on_cycle == "raise" and not (back := level.where("ancestor = descendant")).isEmpty():
            raise ValueError(f"cycle through {back.first()['ancestor']}")
        if depth > max_depth:
            raise ValueError(f"deeper than {max_depth}")
        done = level if done is None else done.unionByName(level)
        level = level.join(step, level["descendant"] == step["parent"]).select("ancestor", F.col("child").alias("descendant")).distinct()
    if done is None:
        return level
    return done.groupBy("ancestor", "descendant").agg(F.max("depth").alias("depth"))


def depths(links: DataFrame) -> DataFrame:
    """(node, depth) by the longest path from a root; roots have depth 0."""
    nodes = links.select(F.col("parent").alias("node")).union(links.select(F.col("child").alias("node"))).distinct()
    below = descendants(links).groupBy(F.col("descendant").alias("node")).agg(F.max("depth").alias("depth"))
    return nodes.join(below, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def safe_depths(links: DataFrame) -> DataFrame:
    """(node, depth) of nodes with one parent each (the smallest): steps to the root; on a way that comes back to a node the steps until then.

    Unlike ``depths`` a cycle doesn't raise: a node that the way has seen counts as a root.
    """
    one = materialize(links.groupBy("child").agg(F.min("parent").alias("parent")), "parents")
    level = one.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.array("child").alias("seen"))
    out = None
    while True:
        level = materialize(level, "level")
        if level.isEmpty():
            break
        # the way goes one step up; it ends at a root or at a node that it has seen
        up = level.join(one.select(F.col("child").alias("at"), F.col("parent").alias("above")), "at", "left")
        ends = F.col("above").isNull() | F.array_contains("seen", F.col("at"))
        done = up.where(ends).select("node", F.size("seen").alias("depth"))
        out = done if out is None else out.unionByName(done)
        level = up.where(~ends).select("node", F.col("above").alias("at"), F.array_append("seen", F.col("at")).alias("seen"))
    roots = links.select(F.col("parent").alias("node")).distinct().join(one.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0))
    return roots if out is None else roots.unionByName(out)


def closure(links: DataFrame, selected: DataFrame) -> DataFrame:
    """(node) of ``selected`` and all that they need, over any number of ``links`` (child, parent); cycles end."""
    step = materialize(links.where("parent IS NOT NULL").select(F.col("child").alias("node"), "parent").distinct(), "links")
    new = materialize(selected.select("node").distinct(), "nodes")
    found = new
    while not new.isEmpty():
        up = new.join(step, "node").select(F.col("parent").alias("node")).distinct()
        new = materialize(up.join(found, "node", "left_anti"), "nodes")
        found = found.unionByName(new)
    return found


def class_order(links: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(node, depth, place): classes after all that they depend on, by longest path and then name. ``extra``: further (parent, child)."""
    x = depths(links if extra is None else links.unionByName(extra.select(*links.columns)))
    # the number of classes before a depth is summed over depths, so only classes of one depth are ordered together
    per = x.groupBy("depth").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("depth").orderBy("node"))
    return x.join(F.broadcast(before), "depth").select("node", "depth", (F.col("_b") + own).alias("place"))
