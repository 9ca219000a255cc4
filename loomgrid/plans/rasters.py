"""Queries of raster operators: every customer is an image, on which orders draw rectangles; priorities are sets.

Images are of one size and as many as the table has customers; all orders are drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parents, raster, regions
from ..storage import materialize, table
from .catalog import named, r6
from .drawings import NEAR, OWNERS, H, W, drawn, drawn_sql, owners, rectangles_sql, runs_sql

_KEY = ["case_id", "set_id"]
#: Sets drawn by orders of even and of odd number.
_EVEN, _ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
_ER = "er AS (SELECT c, s, x, y FROM (SELECT p.c, p.s, p.x, p.y, count(*) n FROM px p CROSS JOIN nb JOIN px q ON q.c = p.c AND q.s = p.s AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3, 4) WHERE n = 9)"


@named(f"WITH {drawn_sql()}, {NEAR} SELECT c AS case_id, s AS set_id, count(DISTINCT (y + dy) * {W} + x + dx) AS grown FROM px, nb WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1} GROUP BY 1, 2")
def dilation(spark, d):
    """RX2: sets grown by a pixel."""
    return raster.dilate(drawn(spark, d), W, H).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("grown"))


@named(f"WITH {drawn_sql()}, {NEAR}, {_ER} SELECT c AS case_id, s AS set_id, count(*) AS inside FROM er GROUP BY 1, 2")
def erosion(spark, d):
    """RX2: pixels whose neighbourhood is inside."""
    return raster.erode(drawn(spark, d), W, H).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("inside"))


@named(f"""WITH RECURSIVE {rectangles_sql()}, l AS (SELECT p.c, p.s, p.k a, q.k b FROM rc p JOIN rc q ON q.c = p.c AND q.s = p.s AND p.x0 <= q.x1 + 1 AND q.x0 <= p.x1 + 1 AND p.y0 <= q.y1 + 1 AND q.y0 <= p.y1 + 1),
r AS (SELECT c, s, a, b FROM l UNION SELECT r.c, r.s, r.a, l.b FROM r JOIN l ON l.a = r.b AND l.c = r.c AND l.s = r.s), m AS (SELECT a k, min(b) m FROM r GROUP BY 1),
g AS (SELECT c, s, m, count(DISTINCT yy * {W} + xx) n FROM (SELECT c, s, m, x0 + dx xx, y0 + dy yy FROM rc JOIN m USING (k), range(0, 12) a(dx), range(0, 9) b(dy) WHERE x0 + dx <= x1 AND y0 + dy <= y1) GROUP BY 1, 2, 3)
SELECT c AS case_id, s AS set_id, count(*) AS components, max(n) AS largest, count(*) FILTER (n >= 60) AS of_sixty FROM g GROUP BY 1, 2""")
def pixel_components(spark, d):
    """RX1: eight-connected components; the SQL joins rectangles that touch."""
    c = raster.components(drawn(spark, d), W, H).groupBy(*_KEY, "component").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") >= 60).alias("of_sixty"))


#: The nearest pixel outside is a neighbour of the set.
_DT = f"""{drawn_sql()}, {NEAR}, ou AS (SELECT DISTINCT c, s, x + dx x, y + dy y FROM px, nb WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1} EXCEPT SELECT * FROM px),
dt AS (SELECT p.c, p.s, p.x, p.y, min((p.x - o.x) ** 2 + (p.y - o.y) ** 2) q FROM px p JOIN ou o ON o.c = p.c AND o.s = p.s GROUP BY 1, 2, 3, 4)"""


@named(f"WITH {_DT} SELECT c AS case_id, s AS set_id, round(max(sqrt(q)), 6) AS deepest, round(avg(sqrt(q)), 6) AS mean FROM dt GROUP BY 1, 2")
def pixel_depth(spark, d):
    """RX3: exact distance of pixels from the outside."""
    return raster.depth(drawn(spark, d), W, H).groupBy(*_KEY).agg(r6(F.max("distance")).alias("deepest"), r6(F.avg("distance")).alias("mean"))


@named(f"WITH {_DT}, k AS (SELECT c, s, greatest(1, sqrt(count(*)) * 0.08) k FROM px GROUP BY 1, 2) SELECT dt.c AS case_id, dt.s AS set_id, round(avg(0.52 + 0.48 * least(sqrt(q) / k, 1)), 6) AS inside FROM dt JOIN k ON k.c = dt.c AND k.s = dt.s GROUP BY 1, 2")
def soft_membership(spark, d):
    """RX4: ownership likelihood inside the sets."""
    # outside a set it is .12 at most
    return raster.soft_membership(drawn(spark, d), W, H).where("p >= 0.5").groupBy(*_KEY).agg(r6(F.avg("p")).alias("inside"))


@named(f"""WITH {rectangles_sql('ra', _EVEN)}, {rectangles_sql('rb', _ODD)} SELECT a.c AS case_id, a.s AS set_id, b.s AS other,
 round(sqrt(min(greatest(0, b.x0 - a.x1, a.x0 - b.x1) ** 2 + greatest(0, b.y0 - a.y1, a.y0 - b.y1) ** 2)), 6) AS distance FROM ra a JOIN rb b ON a.c = b.c GROUP BY 1, 2, 3""")
def pixel_reach(spark, d):
    """RX3: least distance of sets from other sets; the SQL measures rectangles."""
    return raster.reach(drawn(spark, d, where=_EVEN), drawn(spark, d, where=_ODD), W, H).select(*_KEY, "other", r6(F.col("distance")).alias("distance"))


def _edge(name: str, where: str) -> str:
    return f"""{drawn_sql(name + '0', where=where)}, {name}e AS (SELECT p.c, p.s, p.x, p.y FROM {name}0 p CROSS JOIN nb JOIN {name}0 q ON q.c = p.c AND q.s = p.s AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3, 4 HAVING count(*) = 9),
{name} AS (SELECT * FROM {name}0 EXCEPT SELECT * FROM {name}e), {name}g AS (SELECT DISTINCT c, s, x + dx x, y + dy y FROM {name}, nb)"""


@named(f"""WITH {NEAR}, {_edge('a', _EVEN)}, {_edge('b', _ODD)}, p AS (SELECT c, s, avg((bg.x IS NOT NULL)::INT) v FROM a LEFT JOIN bg USING (c, s, x, y) GROUP BY 1, 2), r AS (SELECT c, s, avg((ag.x IS NOT NULL)::INT) v FROM b LEFT JOIN ag USING (c, s, x, y) GROUP BY 1, 2)
SELECT c * 10 + s AS case_id, round(2 * coalesce(p.v, 0) * coalesce(r.v, 0) / greatest(coalesce(p.v, 0) + coalesce(r.v, 0), 1e-12), 6) AS boundary_f1 FROM p FULL JOIN r USING (c, s)""")
def boundary_scores(spark, d):
    """RX7: boundaries within a tolerance of each other."""
    own = lambda w: drawn(spark, d, where=w).select((F.col("case_id") * 10 + F.col("set_id")).alias("case_id"), "set_id", "e")
    return raster.boundary_f1(own(_EVEN), own(_ODD), W, H, 1).select("case_id", r6(F.col("boundary_f1")).alias("boundary_f1"))


_ADJ = f"{OWNERS}, ad AS (SELECT p.c, least(p.s, q.s) a, greatest(p.s, q.s) b, count(*) n FROM ow p JOIN ow q ON p.c = q.c AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) AND p.s <> q.s GROUP BY 1, 2, 3)"


@named(f"WITH {_ADJ} SELECT c AS case_id, a, b, n AS length FROM ad")
def adjacency(spark, d):
    """JN25: shared boundary lengths."""
    return raster.adjacency(owners(spark, d), W).select("case_id", "a", "b", "length")


@named(f"""WITH RECURSIVE {OWNERS}, {runs_sql('ow')}, g AS (SELECT c, s, m, sum(n) n FROM co GROUP BY 1, 2, 3) SELECT c AS case_id, s AS label, sum(n)::BIGINT AS pixels FROM g WHERE n >= 25 GROUP BY 1, 2""")
def clean_labels(spark, d):
    """RX5: small components of labels go; labels fall back to nothing here, and their repair by neighbours is tested by brute force."""
    o = owners(spark, d).select("case_id", "e", F.col("set_id").alias("label"))
    return raster.clean_labels(o, {}, W, H, 25).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("pixels"))


def _merges(steps: int) -> str:
    """CTEs g0..g<steps> (c, s, g): groups after each merge; of five labels four at most can join others."""
    out = "g0 AS (SELECT c, s, s g FROM pe)"
    for k in range(steps):
        out += f""", z{k} AS (SELECT c, g, sum(p) - 2 * coalesce((SELECT sum(ad.n) FROM ad JOIN g{k} x ON x.c = ad.c AND x.s = ad.a JOIN g{k} y ON y.c = ad.c AND y.s = ad.b WHERE ad.c = t.c AND x.g = t.g AND y.g = t.g), 0) p FROM (SELECT g{k}.c, g, p FROM g{k} JOIN pe USING (c, s)) t GROUP BY 1, 2),
o{k} AS (SELECT ad.c, least(x.g, y.g) a, greatest(x.g, y.g) b, sum(n) n FROM ad JOIN g{k} x ON x.c = ad.c AND x.s = ad.a JOIN g{k} y ON y.c = ad.c AND y.s = ad.b WHERE x.g <> y.g GROUP BY 1, 2, 3),
b{k} AS (SELECT * FROM (SELECT o.c, a, b, n / greatest(1, least(greatest(1, u.p), greatest(1, v.p))) v, row_number() OVER (PARTITION BY o.c ORDER BY n / greatest(1, least(greatest(1, u.p), greatest(1, v.p))) DESC, a, b) r FROM o{k} o JOIN z{k} u ON u.c = o.c AND u.g = a JOIN z{k} v ON v.c = o.c AND v.g = b) WHERE r = 1 AND v >= 0.2),
g{k + 1} AS (SELECT g{k}.c, s, CASE WHEN g = b THEN a ELSE g END g FROM g{k} LEFT JOIN b{k} ON b{k}.c = g{k}.c)"""
    return out


@named(f"""WITH {_ADJ}, {NEAR}, pe AS (SELECT c, s, count(*) p FROM (SELECT p.c, p.s, p.x, p.y, count(q.s) n FROM ow p CROSS JOIN nb LEFT JOIN ow q ON q.c = p.c AND q.s = p.s AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3, 4 HAVING n < 9) GROUP BY 1, 2), {_merges(4)}
SELECT c AS case_id, s AS region, g AS merged FROM g4""")
def merged_regions(spark, d):
    """GR11: regions that join, best share of common boundary first."""
    o = owners(spark, d)
    around = raster.boundary(o, W, H).groupBy("case_id", F.col("set_id").alias("region")).agg(F.count(F.lit(1)).alias("perimeter"))
    return raster.merge_regions(around, raster.adjacency(o, W), 0.2)


@named(f"""WITH {drawn_sql()}, p AS (SELECT c, s, x * {H} + y p, x * {H} + y - row_number() OVER (PARTITION BY c, s ORDER BY x * {H} + y) g FROM px), r AS (SELECT c, s, min(p) st, count(*) n FROM p GROUP BY c, s, g),
q AS (SELECT *, st - coalesce(lag(st + n) OVER (PARTITION BY c, s ORDER BY st), 0) gap FROM r), t AS (SELECT c, s, max(st + n) e, string_agg(gap::VARCHAR || ',' || n::VARCHAR, ',' ORDER BY st) k, sum(n) n FROM q GROUP BY 1, 2)
SELECT t.c AS case_id, t.s AS set_id, k || CASE WHEN e < {W * H} THEN ',' || ({W * H} - e)::VARCHAR ELSE '' END AS runs, t.n::BIGINT AS n, u.total FROM t JOIN (SELECT c, s, sum(y * {W} + x)::BIGINT total FROM px GROUP BY 1, 2) u ON u.c = t.c AND u.s = t.s""")
def run_lengths(spark, d):
    """SC5, WN10: sets as run lengths, compressed, and what comes back."""
    runs = materialize(raster.encode_runs(drawn(spark, d), W, H), "runs")
    packed = runs.select(*_KEY, raster.counts_of_text(raster.text_of_counts(F.col("counts"))).alias("counts"), F.lit(W).alias("width"))
    back = raster.decode_runs(packed, "counts", F.lit(H)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("total"))
    return runs.select(*_KEY, F.array_join(F.col("counts").cast("array<string>"), ",").alias("runs")).join(back, _KEY)


@named(f"""WITH {drawn_sql()}, b AS (SELECT c, s, y * {-(-W // 8)} + x // 8 k, sum(1 << (7 - x % 8)::INT) v FROM px GROUP BY 1, 2, 3), a AS (SELECT c, s, count(*) n, sum(y * {W} + x)::BIGINT total FROM px GROUP BY 1, 2)
SELECT a.c AS case_id, a.s AS set_id, md5(string_agg(printf('%02x', coalesce(v, 0)::INT), '' ORDER BY t.k)) AS bits, any_value(n) AS n, any_value(total) AS total FROM a CROSS JOIN range(0, {-(-W // 8) * H}) t(k) LEFT JOIN b ON b.c = a.c AND b.s = a.s AND b.k = t.k GROUP BY 1, 2""")
def packed_bits(spark, d):
    """SC8: sets as packed bits, and what comes back."""
    bits = materialize(raster.pack_bits(drawn(spark, d), W, H), "bits")
    back = raster.unpack_bits(bits, W).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("total"))
    return bits.select(*_KEY, F.md5(F.lower(F.hex("bits")).cast("binary")).alias("bits")).join(back, _KEY)


@named(f"""WITH b AS (SELECT p_partkey k, p_partkey % 20 x, p_size % 20 y, p_partkey % 7 w, p_size % 5 h FROM part) SELECT k % 9 AS set_id, count(DISTINCT yy * {W} + xx) AS n FROM b, range(0, 40) a(xx), range(0, 40) c(yy) WHERE xx BETWEEN x AND x + w AND yy BETWEEN y AND y + h GROUP BY 1""")
def polygons(spark, d):
    """SC5: unions of polygons (here rectangles), edges included."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, w, h = k % 20, s % 20, k % 7, s % 5
    corners = F.array(x, y, x + w, y, x + w, y + h, x, y + h).cast("array<double>")
    e = raster.decode_polygons(table(spark, d, "part").select(F.lit(0).alias("case_id"), (k % 9).alias("set_id"), corners.alias("polygon")), W, H)
    return e.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


_PAL = [(0, 0, 0), (200, 30, 30), (30, 200, 30), (30, 30, 200)]


@named(f"""WITH {OWNERS}, p AS (SELECT c, x, y, x * 4 r, y * 5 g, (x * y + s * 40) % 256 b FROM ow), k(i, r, g, b) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(_PAL))}),
l AS (SELECT c, x, y, arg_min(i, ((p.r - k.r) ** 2 + (p.g - k.g) ** 2 + (p.b - k.b) ** 2, i)) n FROM p, k GROUP BY 1, 2, 3) SELECT c AS case_id, n AS class, count(*) AS pixels FROM l GROUP BY 1, 2""")
def palette_labels(spark, d):
    """SC2, SC3: pixels by the nearest palette colour, classes checked."""
    x, y = F.col("e") % W, F.floor(F.col("e") / W)
    p = owners(spark, d).select("case_id", "e", (x * 4).alias("r"), (y * 5).alias("g"), ((x * y + F.col("set_id") * 40) % 256).alias("b"))
    c = regions.nearest_colour(F.col("r"), F.col("g"), F.col("b"), _PAL)
    return regions.known_classes(p.withColumn("class", c), "class", len(_PAL)).groupBy("case_id", "class").agg(F.count(F.lit(1)).alias("pixels"))


@named(f"""WITH {OWNERS}, ar AS (SELECT c, s, count(*) n FROM ow GROUP BY 1, 2), z AS (SELECT v.c, v.s, o.s k, o.x, o.y, min(greatest(abs(o.x - v.x), abs(o.y - v.y))) m FROM ow v JOIN ow o ON o.c = v.c AND o.s <> v.s AND o.x BETWEEN v.x - 5 AND v.x + 5 AND o.y BETWEEN v.y - 5 AND v.y + 5 GROUP BY 1, 2, 3, 4, 5),
c2 AS (SELECT c, s, k, count(*) FILTER (m <= 1) n1, count(*) n5 FROM z GROUP BY 1, 2, 3 HAVING n1 > 0),
h AS (SELECT c2.c, c2.s, k, n1 / greatest(1, sqrt(va.n * oa.n)) * (0.65 + 0.35 * least(1, n5 / greatest(1, va.n * 0.35))) v FROM c2 JOIN ar va ON va.c = c2.c AND va.s = c2.s JOIN ar oa ON oa.c = c2.c AND oa.s = k WHERE n1 >= greatest(3, round_even(sqrt(va.n) * 0.08, 0)) AND n5 >= greatest(8, round_even(va.n * 0.003, 0)))
SELECT c AS case_id, s AS set_id, k AS other, round(v, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY round(v, 9) DESC, k) rank FROM h) WHERE rank <= 3""")
def occluder_ranks(spark, d):
    """JN22: the three neighbours that most likely hide a set."""
    o = owners(spark, d)
    x = raster.contacts(o, o, W, H, 1, 5)
    return regions.occluders(x).select(*_KEY, "other", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@named("""WITH g AS (SELECT l_orderkey k, l_linenumber n, l_tax * 20 q, 0.7::DOUBLE + l_discount * 3 r, 0.6::DOUBLE + l_tax * 5 p, l_quantity a, 40 + l_partkey % 60 v, 0.7::DOUBLE + l_discount * 3 la, 1.0::DOUBLE + l_tax * 5 sp FROM lineitem), s AS (SELECT *, greatest(6, round_even(v * 0.003, 0)) m, least(greatest(q * r * p * la * least(1, 1.3 / sp) * least(1, a / greatest(1, greatest(6, round_even(v * 0.003, 0)) * 4)), 0), 1) sc FROM g)
SELECT k AS l_orderkey, n AS l_linenumber, CASE WHEN q < 0.30 THEN 'low_model_quality' WHEN r < 0.82 THEN 'visible_target_not_preserved' WHEN p < 0.65 THEN 'proposal_leaks_outside_occluder_search' WHEN a < m THEN 'no_supported_hidden_continuation' WHEN a > round_even(v * 1.5, 0) THEN 'implausible_expansion' WHEN la < 0.78 THEN 'implausible_lateral_spread' WHEN sp > 1.30 THEN 'implausible_orthogonal_span' WHEN sc < 0.45 THEN 'weak_combined_evidence' ELSE 'accepted' END AS reason, round(sc / 7, 6) AS score FROM s""")
def completion_reasons(spark, d):
    """RX13: why completed masks are rejected."""
    t, g = F.col("l_tax"), F.col("l_discount")
    a = (t * 20, 0.7 + g * 3, 0.6 + t * 5, F.col("l_quantity"), 40 + F.col("l_partkey") % 60, 0.7 + g * 3, 1.0 + t * 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", regions.completion_reason(*a).alias("reason"), r6(regions.completion_score(*a) / 7).alias("score"))


@named("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey WHEN p_size % 3 = 1 THEN p_size END AS pixel FROM part""")
def composed_pixels(spark, d):
    """RX14: visible pixels from the source, hidden ones generated."""
    s = F.col("p_size") % 3
    return table(spark, d, "part").select("p_partkey", regions.compose(s == 0, s < 2, F.col("p_partkey"), F.col("p_size").cast("long")).alias("pixel"))


@named("""WITH x AS (SELECT l_orderkey k, l_suppkey o, (l_discount * 100)::INT % 4 v, l_tax t FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, t, o) n FROM x) SELECT k AS piece, CASE WHEN v > 0 OR t <= 0.03 THEN o END AS owner FROM r WHERE n = 1""")
def attached_pieces(spark, d):
    """RX6: pieces go to the owner they overlap most, else to a near one."""
    x = table(spark, d, "lineitem").select(F.lit(0).alias("case_id"), F.col("l_orderkey").alias("piece"), F.col("l_suppkey").alias("owner"), (F.round(F.col("l_discount") * 100).cast("int") % 4).alias("overlap"), F.col("l_tax").alias("distance"))
    return parents.attach(x, 0.03).select("piece", "owner")


@named(f"""WITH e AS (SELECT DISTINCT l_suppkey r, l_partkey % 64 x, l_partkey // 64 y FROM lineitem WHERE (l_partkey % 64) * 2 BETWEEN l_partkey // 64 - 20 AND l_partkey // 64 + 60), m AS (SELECT r, avg(x) mx, avg(y) my, 0.5 * atan2(2 * covar_samp(x, y), covar_samp(x, x) - covar_samp(y, y)) t FROM e GROUP BY 1 HAVING count(*) >= 24),
u AS (SELECT r, (x - mx) * cos(t) + (y - my) * sin(t) u, (y - my) * cos(t) - (x - mx) * sin(t) v FROM e JOIN m USING (r)), s AS (SELECT r, min(u) lo, max(u) hi FROM u GROUP BY 1 HAVING hi - lo >= 8), b AS (SELECT r, least(floor(round((u - lo) / (hi - lo) * 8, 9)), 7)::INT b, count(*) n, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) w FROM u JOIN s USING (r) GROUP BY 1, 2),
g AS (SELECT r, k b, coalesce(n, 0) n, CASE WHEN n >= 2 AND w > 0 THEN w END w FROM (SELECT r FROM b WHERE n >= 2 AND w > 0 GROUP BY 1 HAVING count(*) >= 4) q CROSS JOIN range(0, 8) x(k) LEFT JOIN b USING (r) WHERE b.b = k OR b.b IS NULL),
f AS (SELECT *, last_value(CASE WHEN w IS NOT NULL THEN {{'b': b, 'w': w}} END IGNORE NULLS) OVER (PARTITION BY r ORDER BY b ROWS UNBOUNDED PRECEDING) p, first_value(CASE WHEN w IS NOT NULL THEN {{'b': b, 'w': w}} END IGNORE NULLS) OVER (PARTITION BY r ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) q FROM g),
i AS (SELECT r, b, n, coalesce(p.w + (q.w - p.w) * (b - p.b) / greatest(q.b - p.b, 1), p.w, q.w) w FROM f) SELECT r AS root, b AS bin, n, round((coalesce(lag(w) OVER z, w) + w + coalesce(lead(w) OVER z, w)) / 3, 4) AS width FROM i WINDOW z AS (PARTITION BY r ORDER BY b)""".replace("LEFT JOIN b USING (r) WHERE b.b = k OR b.b IS NULL", "LEFT JOIN b ON b.r = q.r AND b.b = k").replace("g AS (SELECT r, k b", "g AS (SELECT q.r, k b"))
def width_profiles(spark, d):
    """WN12: widths along the main axis."""
    x, y = F.col("l_partkey") % 64, F.floor(F.col("l_partkey") / 64)
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("root"), x.alias("x"), y.alias("y")).where((F.col("x") * 2).between(F.col("y") - 20, F.col("y") + 60)).distinct()
    return regions.width_profile(e, 8).select("root", "bin", "n", F.round("width", 4).alias("width"))
