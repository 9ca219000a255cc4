"""Images that grow with the tables: every customer is one, on which each of their orders draws a rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

W, H = 64, 48
#: Orders of a partition of images; their pixels are some fifty times as many.
PART = 20_000
_SET = "substr(o_orderpriority, 1, 1)::BIGINT"


def parts(spark: SparkSession, d: str) -> int:
    """Partitions for images: no fewer than cores, and PART orders each in large tables."""
    return max(spark.sparkContext.defaultParallelism, table(spark, d, "orders").count() // PART)


def drawn(spark: SparkSession, d: str, of: Column | None = None, where: str = "true", hollow: bool = False) -> DataFrame:
    """(case_id, set_id, e): the union of each set's rectangles. of: the set that an order belongs to, else by its priority; hollow: of every third order only the outline.

    Orders are shuffled by image before they are drawn, so that pixels aren't.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y, w, h = k * 7 % (W - 12), (k * 3 + c) % (H - 10), 5 + k % 8, 4 + F.floor(k / 8) % 6
    o = table(spark, d, "orders").where(where).select(c.alias("case_id"), (F.substring("o_orderpriority", 1, 1).cast("long") if of is None else of).alias("set_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (k % 3 == 0).alias("hollow")).repartition(parts(spark, d), "case_id")
    o = o.withColumn("xx", F.explode(F.sequence("x", F.col("x") + F.col("w") - 1))).withColumn("yy", F.explode(F.sequence("y", F.col("y") + F.col("h") - 1)))
    if hollow:
        edge = F.col("xx").isin(F.col("x"), F.col("x") + F.col("w") - 1) | F.col("yy").isin(F.col("y"), F.col("y") + F.col("h") - 1)
        o = o.where(~F.col("hollow") | edge)
    return o.select("case_id", "set_id", (F.col("yy") * W + F.col("xx")).cast("long").alias("e")).distinct()


def rectangles_sql(name: str = "rc", where: str = "true", of: str = _SET) -> str:
    """CTE (c, s, k, x0, y0, x1, y1), ends included."""
    return f"{name} AS (SELECT c, s, k, x0, y0, x0 + w - 1 x1, y0 + h - 1 y1 FROM (SELECT o_custkey c, {of} s, o_orderkey k, o_orderkey * 7 % {W - 12} x0, (o_orderkey * 3 + o_custkey) % {H - 10} y0, 5 + o_orderkey % 8 w, 4 + (o_orderkey // 8) % 6 h FROM orders WHERE {where}))"


def drawn_sql(name: str = "px", of: str = _SET, where: str = "true", hollow: bool = False) -> str:
    """CTE (c, s, x, y)."""
    outline = " AND (k % 3 <> 0 OR x0 + dx IN (x0, x1) OR y0 + dy IN (y0, y1))" if hollow else ""
    return f"{rectangles_sql('rc_' + name, where, of)}, {name} AS (SELECT DISTINCT c, s, x0 + dx x, y0 + dy y FROM rc_{name}, range(0, 12) a(dx), range(0, 9) b(dy) WHERE x0 + dx <= x1 AND y0 + dy <= y1{outline})"


OWNERS = f"{drawn_sql()}, ow AS (SELECT c, x, y, min(s) s FROM px GROUP BY 1, 2, 3)"
NEAR = "nb(dx, dy) AS (SELECT a.a, b.b FROM (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(b))"


def runs_sql(of: str, name: str = "") -> str:
    """CTEs ru (c, s, id, y, a, b, n) of row runs of ``of`` (c, s, x, y), and co, the same with m, the smallest id of their eight-connected component. Needs RECURSIVE."""
    return f"""ru{name} AS (SELECT c, s, min(y * {W} + x) id, y, min(x) a, max(x) b, count(*) n FROM (SELECT *, x - row_number() OVER (PARTITION BY c, s, y ORDER BY x) g FROM {of}) GROUP BY c, s, y, g),
rl{name} AS (SELECT p.c, p.s, p.id a, q.id b FROM ru{name} p JOIN ru{name} q ON q.c = p.c AND q.s = p.s AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.a <= p.b + 1 AND p.a <= q.b + 1),
rr{name} AS (SELECT c, s, a, b FROM rl{name} UNION SELECT r.c, r.s, r.a, l.b FROM rr{name} r JOIN rl{name} l ON l.c = r.c AND l.s = r.s AND l.a = r.b),
co{name} AS (SELECT ru{name}.*, m FROM ru{name} JOIN (SELECT c, s, a id, min(b) m FROM rr{name} GROUP BY 1, 2, 3) USING (c, s, id))"""


def owners(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive maps (case_id, set_id, e): a pixel of several sets belongs to the smallest."""
    return drawn(spark, d).groupBy("case_id", "e").agg(F.min("set_id").alias("set_id"))
