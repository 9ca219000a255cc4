"""Named queries over the driver tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text, vectors
from ..operators import assignment, evaluation, graph, ordered, overlap, ownership, parents, priors, retrieval, routing, stats, suppression, validation
from ..storage import table
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def named(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def seconds(c: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_date(F.col(c).cast("date")).cast("double") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), F.col(c)).cast("double")


#: Rows of a partition of elements.
DEALT = 1_000_000


def supplied(spark: SparkSession, d: str) -> DataFrame:
    """Elements: parts (e) that a supplier (set) delivers."""
    x = table(spark, d, "lineitem")
    # so many tasks that each one's distinct rows are bounded; what groups by element afterwards isn't shuffled again
    parts = max(spark.sparkContext.defaultParallelism, x.count() // DEALT)
    return x.select(F.lit(0).alias("case_id"), F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("e")).repartition(parts, "e").distinct()


def word_sets(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Sets of hashed three-word shingles, one row a text."""
    x = table(spark, d, name).select(F.lit(0).alias("case_id"), F.col(key).alias("set_id"), text.shingles(F.col("text"), 3, hashed=True).alias("s"))
    return overlap.with_sizes(x)


_E = "e AS (SELECT DISTINCT l_suppkey s, l_partkey e FROM lineitem)"
_W = """w AS (SELECT DISTINCT doc_id s, array_to_string(t[i:i+2], ' ') e FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) i FROM (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') t FROM documents))),
n AS (SELECT s, count(*) n FROM w GROUP BY s),
p AS (SELECT a.s a, b.s b, count(*) i FROM w a JOIN w b ON a.e = b.e AND a.s < b.s GROUP BY 1, 2),
m AS (SELECT a, b, i, x.n na, y.n nb, i / (x.n + y.n - i) iou, i / least(x.n, y.n) containment FROM p JOIN n x ON x.s = a JOIN n y ON y.s = b)"""


@named("""SELECT l_suppkey AS set_id, count(DISTINCT l_partkey) AS area, min(l_partkey % 64) AS x0, min(l_partkey // 64) AS y0, max(l_partkey % 64) + 1 AS x1,
max(l_partkey // 64) + 1 AS y1, round(avg(DISTINCT_X), 6) AS cx, round(avg(DISTINCT_Y), 6) AS cy
FROM (SELECT DISTINCT l_suppkey, l_partkey, (l_partkey % 64)::DOUBLE DISTINCT_X, (l_partkey // 64)::DOUBLE DISTINCT_Y FROM lineitem) GROUP BY 1""")
def set_geometry(spark, d):
    return ownership.geometry(supplied(spark, d), F.lit(64)).select("set_id", "area", "x0", "y0", "x1", "y1", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@named(f"WITH {_W} SELECT a, b, i AS inter, round(iou, 6) AS iou, round(containment, 6) AS containment, round(least(na, nb) / greatest(na, nb), 6) AS area_coherence FROM m WHERE iou >= 0.5")
def overlap_pairs(spark, d):
    x = overlap.set_pairs(word_sets(spark, d), 0.5)
    return x.select("a", "b", "inter", *(r6(F.col(k)).alias(k) for k in ("iou", "containment", "area_coherence")))


@named(f"""WITH {_E}, n AS (SELECT s, count(*) n FROM e GROUP BY s), p AS (SELECT a.s a, b.s b, count(*) i FROM e a JOIN e b ON a.e = b.e AND a.s < b.s GROUP BY 1, 2)
SELECT a, b, i AS inter, round(i / (x.n + y.n - i), 6) AS iou FROM p JOIN n x ON x.s = a JOIN n y ON y.s = b""")
def supplier_overlap(spark, d):
    return overlap.overlap_pairs(supplied(spark, d)).select("a", "b", "inter", r6(F.col("iou")).alias("iou"))


@named(f"""WITH {_W}, o AS (SELECT a x, b y, greatest(iou, containment) o FROM m UNION ALL SELECT b, a, greatest(iou, containment) FROM m),
g AS (SELECT x, max(o) o FROM o JOIN documents dx ON dx.doc_id = x JOIN documents dy ON dy.doc_id = y WHERE dx.lang = dy.lang AND dx.source <> dy.source GROUP BY x)
SELECT doc_id AS set_id, round(coalesce(o, 0), 6) AS agreement FROM documents LEFT JOIN g ON x = doc_id""")
def agreement(spark, d):
    """JN4: the best overlap with any document of the same language and another source; all pairs that share a shingle meet."""
    k = F.col("doc_id").alias("set_id")
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    c = table(spark, d, "documents").select(F.col("lang").alias("case_id"), k, F.col("lang").alias("semantic"), F.col("source").alias("family"))
    # one case a language, as pairs of two don't count
    e = docs.select(F.col("lang").alias("case_id"), k, F.explode(text.shingles(F.col("text"), 3, hashed=True)).alias("e"))
    return overlap.agreement(c, overlap.overlap_pairs(e)).select("set_id", r6(F.col("agreement")).alias("agreement"))


@named(f"""WITH {_W}, x AS (SELECT a p, b c FROM m WHERE iou >= 0.82 UNION ALL SELECT b, a FROM m WHERE iou >= 0.82)
SELECT doc_id AS set_id FROM documents WHERE doc_id NOT IN (SELECT p FROM x JOIN documents dp ON dp.doc_id = p JOIN documents dc ON dc.doc_id = c
WHERE dp.doc_id % 3 = 0 AND dc.doc_id % 3 <> 0 AND dp.lang = dc.lang AND dc.n_chars >= 0.9 * dp.n_chars)""")
def hierarchy_duplicates(spark, d):
    top = F.col("doc_id") % 3 == 0
    c = table(spark, d, "documents").select(F.lit(0).alias("case_id"), F.col("doc_id").alias("set_id"), F.when(top, "whole").otherwise("part").alias("name"), F.when(~top, "whole").alias("parent"), F.col("lang").alias("root"), F.col("n_chars").alias("score"))
    return overlap.hierarchy_duplicates(c, overlap.set_pairs(word_sets(spark, d), 0.82)).select("set_id")


@named(f"""WITH RECURSIVE {_W}, l AS (SELECT a, b FROM m WHERE iou >= 0.82 UNION SELECT b, a FROM m WHERE iou >= 0.82),
r AS (SELECT a, a b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def components(spark, d):
    return graph.connected_components(overlap.set_links(word_sets(spark, d), 0.82))


@named(f"""WITH RECURSIVE {_W}, it AS (SELECT doc_id id, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) place FROM documents), cf AS (SELECT CASE WHEN x.place < y.place THEN a ELSE b END f, CASE WHEN x.place < y.place THEN b ELSE a END s FROM m JOIN it x ON x.id = a JOIN it y ON y.id = b WHERE iou >= 0.82 AND x.lang = y.lang),
nb AS (SELECT s id, list(f) nb FROM cf GROUP BY 1), od AS (SELECT id, nb, row_number() OVER (ORDER BY place) o FROM it JOIN nb USING (id)), g AS (SELECT 0::BIGINT k, []::BIGINT[] g UNION ALL SELECT k + 1, CASE WHEN len(list_filter(nb, lambda x: NOT list_contains(g, x))) > 0 THEN list_append(g, id) ELSE g END FROM g JOIN od ON o = k + 1)
SELECT id AS doc_id, NOT list_contains((SELECT g FROM g ORDER BY k DESC LIMIT 1), id) AS kept FROM it""")
def nms_documents(spark, d):
    """Greedy suppression of near-identical documents of one language, longest first."""
    docs = table(spark, d, "documents")
    place = F.struct((-F.col("n_chars")).alias("n"), "doc_id")
    items = docs.select(F.col("doc_id").alias("item"), place.alias("place"))
    lang = lambda k: docs.select(F.col("doc_id").alias(k), F.col("lang").alias(f"l{k}"))
    pairs = overlap.set_pairs(word_sets(spark, d), 0.82).join(lang("a"), "a").join(lang("b"), "b").where("la = lb")
    return suppression.greedy_suppression(items, pairs.select("a", "b")).select(F.col("item").alias("doc_id"), "kept")


@named(f"""WITH {_W}, d AS (SELECT doc_id, n_chars / 1000.0 s, CASE WHEN doc_id % 4 = 0 THEN 'whole' ELSE 'part' || doc_id % 3 END n, 'whole' p FROM documents), c AS (SELECT a, b FROM m WHERE iou >= 0.3 UNION SELECT b, a FROM m WHERE iou >= 0.3), f AS (SELECT c.a, c.b FROM c JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE x.n <> y.n),
k AS (SELECT a, b, d.* FROM (SELECT a, b FROM f UNION SELECT a, a FROM f) JOIN d ON d.doc_id = b), o AS (SELECT k.*, (SELECT bool_and(q.p = k.n) FROM k q WHERE q.a = k.a AND q.b <> k.b) h FROM k),
g AS (SELECT a, arg_max(b, (s, -b)) FILTER (h) r, list_sort(list(s), 'DESC')[1] - list_sort(list(s), 'DESC')[2] gap FROM o GROUP BY 1), x AS (SELECT DISTINCT b FROM o JOIN g USING (a) WHERE CASE WHEN r IS NOT NULL THEN b <> r ELSE gap < 0.08 END),
t AS (SELECT r, array_to_string(list_sort(list_distinct(list(n))), ',') l FROM o JOIN g USING (a) WHERE b <> r GROUP BY 1) SELECT doc_id, l AS collapsed FROM documents LEFT JOIN t ON r = doc_id WHERE doc_id NOT IN (SELECT b FROM x)""")
def ambiguous_duplicates(spark, d):
    """Documents of unclear kind: parents take their copies in, close scores reject the whole set."""
    k = F.col("doc_id")
    items = table(spark, d, "documents").select(k.alias("item"), (F.col("n_chars") / 1000).alias("score"), F.when(k % 4 == 0, "whole").otherwise(F.concat(F.lit("part"), k % 3)).alias("name"), F.lit("whole").alias("parent"))
    p = overlap.set_pairs(word_sets(spark, d), 0.3)
    for s in ("a", "b"):
        p = p.join(items.select(F.col("item").alias(s), F.col("name").alias(f"n{s}_")), s)
    return suppression.ambiguous_duplicates(items, p.where("na_ <> nb_").select("a", "b")).select(F.col("item").alias("doc_id"), F.array_join("collapsed", ",").alias("collapsed"))


@named("""WITH b AS (SELECT o_orderkey k, epoch(o_orderdate) / 86400.0 x0, epoch(o_orderdate) / 86400.0 + 3 x1, o_totalprice y0, o_totalprice + 500 y1, o_orderpriority c FROM orders),
p AS (SELECT a.k a, b.k b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) i FROM b a JOIN b b ON a.c = b.c AND a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT a, b, round(i / (3000 - i), 4) AS iou FROM p""")
def box_iou(spark, d):
    day = seconds("o_orderdate") / 86400
    boxes = table(spark, d, "orders").select(F.col("o_orderpriority").alias("case_id"), F.col("o_orderkey").alias("box_id"), day.alias("x0"), F.col("o_totalprice").alias("y0"), (day + 3).alias("x1"), (F.col("o_totalprice") + 500).alias("y1"))
    return overlap.box_pairs(boxes, 6.0, 1000.0).select("a", "b", F.round("iou", 4).alias("iou"))


@named("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) n FROM part) WHERE n <= 3""")
def quota_topk(spark, d):
    return suppression.quota(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey")


@named("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) turn FROM part)
SELECT p_partkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY turn2, p_retailprice DESC, p_partkey) n FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_retailprice DESC, p_partkey) turn2 FROM t)) WHERE n <= 10 AND turn2 = turn2""".replace("SELECT p_partkey, turn FROM", "SELECT p_partkey, turn2 AS turn FROM"))
def round_robin(spark, d):
    return suppression.round_robin(table(spark, d, "part"), ["p_size"], ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "turn")


@named("""SELECT s_suppkey FROM (SELECT *, min(CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 7 END) OVER (PARTITION BY s_nationkey) c, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) n FROM supplier) WHERE c IS NULL OR n <= c""")
def instance_cap(spark, d):
    s = table(spark, d, "supplier").withColumn("cap", F.col("s_suppkey") % 7)
    return suppression.instance_cap(s, ["s_nationkey"], "cap", [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey")


@named("""SELECT l_partkey, round(1 - exp(sum(ln(1 - p))), 6) AS probability FROM (SELECT l_partkey, l_returnflag, max(l_discount) p FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def noisy_or(spark, d):
    return ownership.noisy_or(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "l_discount").select("l_partkey", r6(F.col("probability")).alias("probability"))


@named("""SELECT l_partkey AS e, owner, round(q, 6) AS owner_score FROM (SELECT l_partkey, l_suppkey owner, q, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) n
FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) q FROM lineitem GROUP BY 1, 2)) WHERE n = 1""")
def argmax_owner(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"))
    return ownership.argmax_owner(q, ["e"], "s", "q").select("e", "owner", r6(F.col("owner_score")).alias("owner_score"))


@named(f"""WITH {_E}, c AS (SELECT p_partkey, count(e.s) n FROM part LEFT JOIN e ON e.e = p_partkey GROUP BY 1)
SELECT round(sum(greatest(n - 1, 0)) / count(*), 6) AS overlap_excess, round(count(*) FILTER (n = 0) / count(*), 6) AS unassigned, max(n) <= 1 AS exclusive FROM c""")
def cover_excess(spark, d):
    root = table(spark, d, "part").select(F.lit(0).alias("case_id"), F.col("p_partkey").alias("e"))
    return ownership.cover(supplied(spark, d), root).select(r6(F.col("overlap_excess")).alias("overlap_excess"), r6(F.col("unassigned")).alias("unassigned"), "exclusive")


@named("""WITH p AS (SELECT DISTINCT o_orderpriority c, l_partkey e FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT o_orderpriority c, l_partkey e FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'),
x AS (SELECT coalesce(p.c, t.c) c, p.e pe, t.e te FROM p FULL JOIN t ON p.c = t.c AND p.e = t.e)
SELECT c AS case_id, round(count(*) FILTER (pe IS NOT NULL AND te IS NOT NULL) / count(*), 6) AS iou, round(count(*) FILTER (pe IS NOT NULL AND te IS NOT NULL) / greatest(count(pe), 1), 6) AS "precision", round(count(*) FILTER (pe IS NOT NULL AND te IS NOT NULL) / greatest(count(te), 1), 6) AS recall FROM x GROUP BY 1""")
def union_metrics(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("case_id"), F.col("l_partkey").alias("e"), "l_returnflag", "l_linestatus")
    m = ownership.union_metrics(x.where("l_returnflag = 'R'"), x.where("l_linestatus = 'F'"))
    return m.select("case_id", *(r6(F.col(k)).alias(k) for k in ("iou", "precision", "recall")))


@named("""WITH a AS (SELECT DISTINCT l_partkey e FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey e FROM lineitem WHERE l_returnflag = 'A')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_algebra(spark, d):
    x = table(spark, d, "lineitem").select(F.lit(0).alias("case_id"), F.col("l_partkey").alias("e"), "l_returnflag")
    a, b = x.where("l_returnflag = 'R'"), x.where("l_returnflag = 'A'")
    out = None
    for op in ("union", "intersection", "difference"):
        one = ownership.combine(a, b, op).agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links and own values of the tree region - nation - customer."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    r = lambda k: F.concat(F.lit("r"), F.col(k).cast("string"))
    nn = lambda k: F.concat(F.lit("n"), F.col(k).cast("string"))
    cc = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    links = n.select(r("n_regionkey").alias("parent"), nn("n_nationkey").alias("child")).union(c.select(nn("c_nationkey"), cc))
    return links, n.select(nn("n_nationkey").alias("node"), F.lit(100000.0).alias("value")).union(c.select(cc, "c_acctbal"))


_TREE = "t AS (SELECT 'r' || n_regionkey p, 'n' || n_nationkey c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@named(f"WITH {_TREE} SELECT node, max(depth) AS depth FROM (SELECT p node, 0 depth FROM t WHERE p LIKE 'r%' UNION ALL SELECT c, 1 FROM t WHERE c LIKE 'n%' UNION ALL SELECT c, 2 FROM t WHERE c LIKE 'c%') GROUP BY 1")
def taxonomy_depth(spark, d):
    return graph.depths(_places(spark, d)[0])


@named(f"WITH RECURSIVE {_TREE}, r AS (SELECT p a, c b, 1 k FROM t UNION ALL SELECT a, c, k + 1 FROM r JOIN t ON p = b) SELECT a AS ancestor, b AS descendant, k AS depth FROM r")
def descendants(spark, d):
    return graph.descendants(_places(spark, d)[0])


@named("""SELECT 'n' || n_nationkey AS node, round(greatest(100000 - coalesce(s, 0), 0), 2) AS residual FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) s FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, round(greatest(c_acctbal, 0), 2) FROM customer""")
def parent_residual(spark, d):
    links, values = _places(spark, d)
    return ownership.parent_residual(values, links).select("node", F.round("residual", 2).alias("residual"))


@named("""SELECT s_suppkey, n_name || '-' || lpad(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::VARCHAR, 2, '0') AS stable_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def stable_ids(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", scores.numbered(F.col("n_name"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")]).alias("stable_id"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("case_id"), F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("e"), (F.month("l_shipdate") <= 6).alias("first"))
    return x.where("first").drop("first").distinct(), x.where("NOT first").drop("first").distinct()


@named()
def id_carryover(spark, d):
    """Suppliers' sets of the second half-year take the ids of the best matching sets of the first."""
    previous, current = _halves(spark, d)
    ids = previous.select("case_id", "set_id").distinct()
    ids = ids.withColumn("part_id", scores.numbered(F.lit("part"), ["case_id"], [F.col("set_id")]))
    place = lambda x: ownership.geometry(x, F.lit(64)).select("case_id", "set_id", F.lit("part").alias("name"), "cx", "cy")
    pairs = assignment.carry_scores(overlap.cross_overlap(current, previous), place(current), place(previous), F.lit(80.0))
    return assignment.carry_ids(current.select("case_id", "set_id").distinct(), ids, pairs, 0.2)


@named()
def f1_thresholds(spark, d):
    """Precision, recall and F1 at eleven IoU thresholds of the second half-year's sets against the first's."""
    previous, current = _halves(spark, d)
    return assignment.threshold_scores(current, previous)


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) v FROM embeddings)"
_PROTO = f"{_UNIT}, d AS (SELECT label, k, avg(v[k]) x FROM u, range(1, 65) r(k) GROUP BY 1, 2), g AS (SELECT label, list(x ORDER BY k) x FROM d GROUP BY 1), p AS (SELECT label, list_transform(x, lambda y: y / greatest(sqrt(list_sum(list_transform(x, lambda z: z * z))), 1e-8)) v FROM g)"
_SIM = f"{_PROTO}, s AS (SELECT vec_id, p.label, list_dot_product(u.v, p.v) s FROM u, p)"


@named(f"WITH {_PROTO} SELECT label, round(v[1], 6) AS first, round(v[64], 6) AS last FROM p")
def label_prototypes(spark, d):
    p = retrieval.prototypes(table(spark, d, "embeddings"), "label", "embedding")
    return p.select("label", r6(F.element_at("prototype", 1)).alias("first"), r6(F.element_at("prototype", -1)).alias("last"))


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = table(spark, d, "embeddings")
    p = retrieval.prototypes(e, "label", "embedding").select(F.col("label").alias("id"), "label", F.col("prototype").alias("v"))
    return retrieval.similar(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), p, k)


@named(f"WITH {_SIM}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) n, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) s2 FROM s) SELECT vec_id, label, round(s, 5) AS similarity, round(s - s2, 5) AS margin FROM t WHERE n = 1")
def asset_route(spark, d):
    h = _hits(spark, d)
    w = Window.partitionBy("query").orderBy("rank")
    x = h.withColumn("margin", F.col("similarity") - F.lead("similarity").over(w)).where("rank = 1")
    return x.select(F.col("query").alias("vec_id"), "label", F.round("similarity", 5).alias("similarity"), F.round("margin", 5).alias("margin"))


@named(f"""WITH {_SIM}, w AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) / 0.055) w FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) n, lead(w) OVER (PARTITION BY vec_id ORDER BY w DESC, label) w2, sum(w) OVER (PARTITION BY vec_id) z FROM w)
SELECT vec_id, label, round(w / z, 5) AS share, round((w - w2) / w, 5) AS margin, s >= 0.2 AND (w - w2) / w >= 0.5 AS accepted FROM t WHERE n = 1""")
def retrieval_plan(spark, d):
    return retrieval.label_route(_hits(spark, d), min_score=0.2, min_margin=0.5).select(F.col("query").alias("vec_id"), "label", F.round("share", 5).alias("share"), F.round("margin", 5).alias("margin"), "accepted")


@named(f"WITH {_SIM}, t AS (SELECT vec_id, label, exp(greatest((s - max(s) OVER (PARTITION BY vec_id)) / 0.1, -40)) e, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) r FROM s) SELECT vec_id, label, r AS rank, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS probability FROM t")
def softmax_rank(spark, d):
    w = Window.partitionBy("query")
    return _hits(spark, d).select(F.col("query").alias("vec_id"), "label", F.col("rank").cast("long").alias("rank"), F.round(scores.softmax(F.col("similarity"), w, 0.1), 5).alias("probability"))


@named(f"""WITH {_SIM}, a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) ra, row_number() OVER (PARTITION BY vec_id ORDER BY s * (1 + (label % 3) / 10.0) DESC, label) rb FROM s),
c AS (SELECT vec_id, label, (s + s * (1 + (label % 3) / 10.0)) / 2 - 0.02 * abs(ra - rb) x FROM a)
SELECT vec_id, label, round(x, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, label) n FROM c) WHERE n = 1""")
def ranker_consensus(spark, d):
    h = _hits(spark, d).select(F.col("query").alias("region"), "label", F.col("similarity").alias("probability"))
    second = h.withColumn("probability", F.col("probability") * (1 + (F.col("label") % 3) / 10))
    return retrieval.consensus(h, second).where("rank = 1").select(F.col("region").alias("vec_id"), "label", F.round("score", 5).alias("score"))


@named(f"WITH {_SIM}, t AS (SELECT *, max(s) OVER (PARTITION BY vec_id) m, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) n FROM s) SELECT vec_id, label FROM t WHERE s >= m - 0.05 AND n <= 3")
def candidate_set(spark, d):
    return retrieval.candidate_set(_hits(spark, d), "query", "similarity", 0.05, 3, [F.col("label")]).select(F.col("query").alias("vec_id"), "label")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@named(f"""WITH n AS (SELECT DISTINCT {_NORM.format('p_name')} name FROM part), p AS (SELECT DISTINCT {_NORM.format('p_type')} phrase FROM part),
x AS (SELECT *, list_distinct(string_split(name, ' ')) a, list_distinct(string_split(phrase, ' ')) b FROM n, p WHERE len(list_intersect(string_split(name, ' '), string_split(phrase, ' '))) > 0),
y AS (SELECT name, phrase, CASE WHEN name = phrase THEN 1.0 WHEN contains(' ' || name || ' ', ' ' || phrase || ' ') THEN 0.88 WHEN contains(' ' || phrase || ' ', ' ' || name || ' ') THEN 0.86 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END::DOUBLE s FROM x)
SELECT name, phrase, round(s, 6) AS score FROM y WHERE s >= 0.2""")
def phrase_match(spark, d):
    p = table(spark, d, "part")
    names, phrases = p.select(text.normalize(F.col("p_name")).alias("name")), p.select(text.normalize(F.col("p_type")).alias("phrase"), F.lit(0).alias("label"))
    return retrieval.lexical(names, phrases, 0.2).select("name", "phrase", r6(F.col("score")).alias("score"))


@named("""WITH i AS (SELECT doc_id, pos, trim(x) x FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\n,;，；]+')) x, generate_subscripts(regexp_split_to_array(text, '[\\n,;，；]+'), 1) pos FROM documents)),
s AS (SELECT doc_id, trim(regexp_replace(lower(trim(string_split(x, '=')[1])), '[^a-z0-9]+', '_', 'g'), '_') label FROM i WHERE x <> '') SELECT doc_id, count(*) AS items, count(DISTINCT label) AS labels FROM s WHERE label <> '' GROUP BY 1""")
def prompt_parse(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(text.prompt_items(F.col("text"))).alias("i"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("i.label").alias("labels"))


@named(f"""WITH {_W}, q AS (SELECT DISTINCT item_id q, array_to_string(t[i:i+2], ' ') e FROM (SELECT item_id, t, unnest(range(1, len(t) - 1)) i FROM (SELECT item_id, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') t FROM benchmark))),
nq AS (SELECT q, count(*) n FROM q GROUP BY 1) SELECT s AS doc_id, q AS item_id, count(*) AS inter, round(count(*) / max(nq.n), 6) AS contained FROM w JOIN q USING (e) JOIN nq USING (q) GROUP BY 1, 2 HAVING count(*) / max(nq.n) >= 0.5""")
def benchmark_containment(spark, d):
    x = overlap.held_in(word_sets(spark, d, "benchmark", "item_id"), word_sets(spark, d), 0.5)
    return x.withColumn("contained", F.col("inter") / F.col("nb")).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "inter", r6(F.col("contained")).alias("contained"))


@named("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")


@named("""WITH x AS (SELECT lang, n_chars < 1500 p, quality = 0 t FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p AND t) tp, count(*) FILTER (p AND NOT t) fp, count(*) FILTER (NOT p AND t) fn, count(*) FILTER (NOT p AND NOT t) tn FROM x GROUP BY 1)
SELECT lang, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) AS f1 FROM c""")
def confusion_f1(spark, d):
    x = stats.confusion(_judged(spark, d), ["lang"], F.col("n_chars") < 1500, F.col("quality") == 0)
    return x.select("lang", "tp", "fp", "fn", "tn", *(r6(F.col(k)).alias(k) for k in ("precision", "recall", "f1")))


@named("""WITH p AS (SELECT doc_id, n_chars, quality = 0 f, unnest(['all', 'long', 'labelled_clean']) policy, toxic FROM labels JOIN documents USING (doc_id)), t AS (SELECT *, CASE policy WHEN 'all' THEN true WHEN 'long' THEN n_chars >= 1000 ELSE toxic = 0 END k FROM p)
SELECT policy, round(avg(k::INT), 6) AS coverage, round(avg(f::INT) FILTER (k), 6) AS failure_rate, round(avg(n_chars) FILTER (k), 4) AS mean FROM t GROUP BY 1""")
def coverage_tiers(spark, d):
    x = stats.coverage_tiers(_judged(spark, d), {"all": F.lit(True), "long": F.col("n_chars") >= 1000, "labelled_clean": F.col("toxic") == 0}, F.col("quality") == 0, "n_chars")
    return x.select("policy", r6(F.col("coverage")).alias("coverage"), r6(F.col("failure_rate")).alias("failure_rate"), F.round("mean", 4).alias("mean"))


_RULES = {"short": "n_chars < 300", "shouting": "len(string_split(text, '!!')) - 1 > 5", "tables": "len(string_split(text, '|')) - 1 > 5", "marks": "len(regexp_extract_all(text, '[#*$%&]{3}')) > 5"}


@named(f"""WITH f AS (SELECT quality = 0 t, {', '.join(f"coalesce({v}, false) {k}" for k, v in _RULES.items())} FROM labels JOIN documents USING (doc_id)),
p AS ({' UNION ALL '.join(f"SELECT '{a}' a, {b if b == 'NULL' else repr(b)} b, 2 * count(*) FILTER (({a}{'' if b == 'NULL' else ' OR ' + b}) AND t) / greatest(1, count(*) FILTER ({a}{'' if b == 'NULL' else ' OR ' + b}) + count(*) FILTER (t)) f1, count(*) FILTER ({a}{'' if b == 'NULL' else ' OR ' + b}) / count(*) r FROM f" for a in _RULES for b in ['NULL', *_RULES] if a != b)}),
x AS (SELECT a, f1 FROM p WHERE b IS NULL ORDER BY f1 DESC, r, a LIMIT 1), y AS (SELECT p.b, p.f1 FROM p JOIN x ON x.a = p.a WHERE p.b IS NOT NULL ORDER BY p.f1 DESC, r, p.b LIMIT 1) SELECT 0 AS place, a AS rule FROM x WHERE f1 >= 0.02 UNION ALL SELECT 1, b FROM y, x WHERE x.f1 >= 0.02 AND y.f1 - x.f1 >= 0.02""")
def rule_selection(spark, d):
    """The rules that best predict low quality, chosen greedily."""
    rules = {"short": F.col("n_chars") < 300, "shouting": F.regexp_count("text", F.lit("!!")) > 5, "tables": F.regexp_count("text", F.lit("[|]")) > 5, "marks": F.regexp_count("text", F.lit("[#*$%&]{3}")) > 5}
    chosen = stats.select_rules(_judged(spark, d), rules, F.col("quality") == 0)
    return spark.createDataFrame([(k, n) for k, n in enumerate(chosen)], "place int, rule string")


@named("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, o_orderpriority), ())""")
def group_summary(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m, p = F.col("c_mktsegment"), F.col("o_orderpriority")
    return x.groupingSets([[m], [m, p], []], m, p).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 3).alias("median"))


_DELTA = "m AS (SELECT o_custkey c, o_orderstatus v, max(o_totalprice) x FROM orders GROUP BY 1, 2), d AS (SELECT a.c, a.v, a.x - b.x delta FROM m a JOIN m b ON a.c = b.c AND b.v = 'O' WHERE a.v <> 'O')"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("x"))
    return stats.paired_delta(m, "o_custkey", "o_orderstatus", "x", "O", ["F", "P"])


@named(f"WITH {_DELTA} SELECT c AS o_custkey, v AS variant, round(delta, 2) AS delta FROM d")
def pivot_paired_delta(spark, d):
    return _deltas(spark, d).select("o_custkey", "variant", F.round("delta", 2).alias("delta"))


@named()
def bootstrap_ci(spark, d):
    """Percentile intervals of the mean paired delta, per variant."""
    return stats.bootstrap(_deltas(spark, d), "delta", stratum="variant")


@named()
def cluster_bootstrap_ci(spark, d):
    """Interval of the mean account balance when nations are drawn."""
    return stats.cluster_bootstrap(table(spark, d, "customer"), "c_nationkey", "c_acctbal")


@named("""WITH c AS (SELECT lang, count(*) FILTER (quality = 1) h, count(*) n, h / n p FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM c, (SELECT 1.959963984540054::DOUBLE z)""")
def wilson(spark, d):
    x = _judged(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("h"), F.count(F.lit(1)).alias("n")).withColumn("w", stats.wilson(F.col("h"), F.col("n")))
    return x.select("lang", r6(F.col("w.low")).alias("low"), r6(F.col("w.high")).alias("high"))


@named("""WITH x AS (SELECT (n_chars >= 300) = (quality = 1) a, (len(string_split(text, '!!')) - 1 <= 5) = (quality = 1) b FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) FILTER (a AND NOT b) b, count(*) FILTER (NOT a AND b) c FROM x),
t AS (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))) t FROM n, range(0, (SELECT least(b, c) + 1 FROM n)) r(k)) SELECT b AS only_first, c AS only_second, round(least(1.0, 2 * t), 9) AS p FROM n, t""")
def mcnemar(spark, d):
    """Exact test of two quality rules that disagree."""
    a, b = F.col("n_chars") >= 300, F.regexp_count("text", F.lit("!!")) <= 5
    right = lambda rule: rule == (F.col("quality") == 1)
    r = _judged(spark, d).agg(F.count_if(right(a) & ~right(b)).alias("b"), F.count_if(~right(a) & right(b)).alias("c")).first()
    return spark.createDataFrame([(r["b"], r["c"], round(stats.mcnemar(r["b"], r["c"]), 9))], "only_first long, only_second long, p double")


@named("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 b FROM part) SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice").select(r6(F.col("rho")).alias("rho"))


@named("""WITH x AS (SELECT least(floor(l_discount * 10), 9)::INT b, l_discount w, (l_returnflag = 'R')::INT h FROM lineitem) SELECT b AS bin, count(*) AS n, round(avg(w), 6) AS mean_weight, round(avg(h), 6) AS hit_rate, round(avg((w - h) ** 2), 6) AS brier FROM x GROUP BY 1""")
def reliability_bins(spark, d):
    x = stats.reliability_bins(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R")
    return x.select("bin", "n", *(r6(F.col(k)).alias(k) for k in ("mean_weight", "hit_rate", "brier")))


@named("""SELECT 'lineitem_pk' AS rule, count(*) AS keys, sum(n)::BIGINT AS rows FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'orders_customer', count(DISTINCT o_custkey), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
UNION ALL SELECT 'lineitem_order', count(DISTINCT l_orderkey), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0
UNION ALL SELECT 'lineitem_part', count(DISTINCT l_partkey), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) HAVING count(*) > 0
UNION ALL SELECT 'labels_document', count(DISTINCT doc_id), count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0""")
def fk_validation(spark, d):
    t = lambda n: table(spark, d, n)
    found = validation.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem_pk")
    for rows, key, parent, parent_key, rule in (("orders", "o_custkey", "customer", "c_custkey", "orders_customer"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem_order"), ("lineitem", "l_partkey", "part", "p_partkey", "lineitem_part"), ("labels", "doc_id", "documents", "doc_id", "labels_document")):
        found = found.unionByName(validation.orphans(t(rows), key, t(parent), parent_key, rule))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"))


@named("""SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN n_chars <> length(text) THEN 'wrong_length' WHEN length(text) < 50 THEN 'no_parts_found' WHEN lang <> 'en' THEN 'review_recommended' ELSE 'ready' END AS status,
array_to_string(list_filter([CASE WHEN length(text) < 50 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN source = 'src0' THEN 'hot_source' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def quality_report(spark, d):
    x = table(spark, d, "documents")
    n = F.length("text")
    status = validation.ladder([("empty", F.col("text").isNull() | (n == 0)), ("wrong_length", F.col("n_chars") != n), ("no_parts_found", n < 50), ("review_recommended", F.col("lang") != "en")], "ready")
    why = validation.reasons([("short", n < 50), ("foreign", F.col("lang") != "en"), ("hot_source", F.col("source") == "src0")])
    return x.select("doc_id", status.alias("status"), F.array_join(why, ",").alias("reasons"))


@named("""WITH r(rule, metric, op, value) AS (VALUES ('big', 'o_totalprice', '>', 300000.0), ('small', 'o_totalprice', '<=', 5000.0)) SELECT o_orderkey, rule FROM orders, r WHERE (op = '>' AND o_totalprice > value) OR (op = '<=' AND o_totalprice <= value)""")
def rule_table(spark, d):
    rules = spark.createDataFrame([("big", "o_totalprice", ">", 300000.0), ("small", "o_totalprice", "<=", 5000.0)], "rule string, metric string, op string, value double")
    return validation.rule_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.broadcast(rules))


@named("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END s FROM events),
g AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY n) i FROM f) SELECT user_id, max(i)::BIGINT AS islands, count(*) AS n FROM g GROUP BY 1""")
def islands(spark, d):
    """Runs of a user's events that are at most an hour apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = seconds("ts")
    x = table(spark, d, "events").withColumn("s", F.when(t - F.lag(t).over(w) <= 3600, 0).otherwise(1))
    return x.groupBy("user_id").agg(F.sum("s").alias("islands"), F.count(F.lit(1)).alias("n"))


@named("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark, d):
    """An extension: daily windows of events, as the stream computes them."""
    x = windows.tumbling(table(spark, d, "events"), "1 day", ["event_type"], "value")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@named("""WITH s AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT 'input' AS stage, count(*) AS n FROM s UNION ALL SELECT 'long_enough', count(*) FROM s WHERE n_chars >= 200 UNION ALL SELECT 'english', count(*) FROM s WHERE n_chars >= 200 AND lang = 'en'
UNION ALL SELECT 'capped', count(*) FROM (SELECT row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) n FROM s WHERE n_chars >= 200 AND lang = 'en') WHERE n <= 20""")
def stage_funnel(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    a = x.where("n_chars >= 200")
    b = a.where("lang = 'en'")
    c = suppression.quota(b, ["source"], [F.desc("n_chars"), F.col("doc_id")], 20)
    out = None
    for name, rows in (("input", x), ("long_enough", a), ("english", b), ("capped", c)):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@named("""SELECT o_orderpriority, round(avg(m), 6) AS mean FROM (SELECT o_orderpriority, CASE WHEN max(o_totalprice) OVER w - min(o_totalprice) OVER w < 1e-12 THEN 0.5 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END m FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY 1""")
def min_max_scores(spark, d):
    m = scores.min_max(F.col("o_totalprice"), Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderpriority", m.alias("m")).groupBy("o_orderpriority").agg(r6(F.avg("m")).alias("mean"))


@named("""SELECT s_suppkey, round(least(greatest((0.45 + 0.55 * least(greatest(s_acctbal / 10000, 0), 1)) * (0.5 + (s_suppkey % 5) / 10.0) * 0.9, 0.01), 0.995), 6) AS calibrated FROM supplier""")
def calibrated_scores(spark, d):
    c = scores.calibrated(F.col("s_acctbal") / 10000, 0.5 + (F.col("s_suppkey") % 5) / 10, F.lit(0.9))
    return table(spark, d, "supplier").select("s_suppkey", r6(c).alias("calibrated"))


@named("""WITH c AS (SELECT p_type, count(*) + 1 n FROM part GROUP BY 1), f AS (SELECT p_type, 1 / sqrt(n / sum(n) OVER ()) w FROM c) SELECT p_type, round(least(greatest(w / (SELECT median(w) FROM f), 0.25), 12), 6) AS weight FROM f""")
def class_weights(spark, d):
    c = table(spark, d, "part").groupBy("p_type").agg((F.count(F.lit(1)) + 1).alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.percentile(1 / F.sqrt("n"), F.lit(0.5)).alias("m"))  # one row
    w = (1 / F.sqrt("n")) / F.col("m")
    return c.join(F.broadcast(total)).select("p_type", r6(scores.clip(w, 0.25, 12.0)).alias("weight"))


@named("""SELECT doc_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 5) AS cosine FROM (SELECT e.vec_id doc_id, e.embedding::DOUBLE[] a, f.embedding::DOUBLE[] b FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1)""")
def next_cosine(spark, d):
    e = table(spark, d, "embeddings")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(f, "vec_id").select(F.col("vec_id").alias("doc_id"), F.round(vectors.cosine(F.col("embedding"), F.col("b")), 5).alias("cosine"))


@named(f"""WITH {_W}, x AS (SELECT CASE WHEN na >= nb THEN b ELSE a END c, CASE WHEN na >= nb THEN a ELSE b END p, greatest(na, nb) n FROM m WHERE containment >= 0.9 AND least(na, nb) <= 0.72 * greatest(na, nb)),
t AS (SELECT c, p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n, p) k FROM x) WHERE k = 1) SELECT t.c AS child, t.p AS parent, CASE WHEN u.c IS NULL THEN 1 ELSE 2 END AS depth FROM t LEFT JOIN t u ON u.c = t.p""")
def enclosing_documents(spark, d):
    """Documents inside larger ones, by their shingles."""
    return parents.enclosing(overlap.smallest_containers(word_sets(spark, d), 0.9, 0.72)).select("child", "parent", "depth")


@named("""WITH x AS (SELECT l_orderkey c, l_suppkey p, l_linenumber % 3 t, l_discount o, l_tax d, l_quantity s FROM lineitem), m AS (SELECT *, min(t) OVER (PARTITION BY c) mt FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o DESC, d, s DESC, p) k FROM m WHERE t = mt)
SELECT c AS child, p AS parent FROM r WHERE k = 1 AND (o >= 0.02 OR d <= 0.01)""")
def best_parent(spark, d):
    x = table(spark, d, "lineitem").select(F.lit(0).alias("case_id"), F.col("l_orderkey").alias("child"), F.col("l_suppkey").alias("parent"), (F.col("l_linenumber") % 3).alias("tier"), F.col("l_discount").alias("overlap"), F.col("l_tax").alias("distance"), F.col("l_quantity").alias("support"))
    return parents.best_parent(x, 0.02, 0.01).select("child", "parent")


@named("""WITH c AS (SELECT p_type, p_brand, count(*) c, min(p_partkey) f FROM part GROUP BY 1, 2) SELECT p_type, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY c DESC, f) k FROM c) WHERE k = 1""")
def first_mode(spark, d):
    return priors.mode(table(spark, d, "part"), ["p_type"], "p_brand", "p_partkey")


@named("""WITH e AS (SELECT o_custkey a, 1.0 + o_custkey % 3 w, o_orderpriority n, o_totalprice / 500000 g FROM orders), t AS (SELECT sum(w) t FROM (SELECT DISTINCT a, w FROM e)), p AS (SELECT n, a, max(w) w, count(*) c FROM e GROUP BY 1, 2)
SELECT p.n AS name, round(max(x.w) / max(t), 6) AS prevalence, max(x.s) AS support, max(x.q)::INT AS maximum_instances, round(avg(g), 6) AS mean, round(greatest(stddev_pop(g), 0.04), 6) AS std FROM (SELECT DISTINCT n FROM p) p JOIN (SELECT n, sum(w) w, count(*) s, ceil(quantile_cont(c::DOUBLE, 0.9)) q FROM p GROUP BY 1) x ON x.n = p.n JOIN e ON e.n = p.n, t GROUP BY 1""")
def part_priors(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("asset"), (1.0 + F.col("o_custkey") % 3).alias("weight"), F.col("o_orderpriority").alias("name"), F.array(F.col("o_totalprice") / 500000).alias("geometry"))
    p = priors.part_priors(e)
    return p.select("name", r6(F.col("prevalence")).alias("prevalence"), "support", "maximum_instances", r6(F.col("geometry_mean")[0]).alias("mean"), r6(F.col("geometry_std")[0]).alias("std"))


@named("""WITH c AS (SELECT p_type, count(*) n FROM part GROUP BY 1) SELECT p_type, round(1 / sqrt(n) / (SELECT sum(n / sqrt(n)) / sum(n) FROM c), 6) AS weight FROM c""")
def frequency_weights(spark, d):
    return priors.frequency_weights(table(spark, d, "part"), "p_type").select("p_type", r6(F.col("weight")).alias("weight"))


@named("""WITH c AS (SELECT o_custkey c, o_orderpriority m, sum(o_totalprice) / 1e6 s, min(o_orderpriority) OVER (PARTITION BY o_custkey) u FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus),
g AS (SELECT c, m, count(*) n, sum(s) s, max(s) b, min(u) u FROM c GROUP BY 1, 2), h AS (SELECT *, max(b) OVER w t, sum(n) OVER w a, max(CASE WHEN m = u AND b >= (SELECT max(b) FROM g x WHERE x.c = g.c) - 0.02 THEN 1 ELSE 0 END) OVER w z, row_number() OVER (PARTITION BY c ORDER BY n DESC, s DESC, b DESC, m) k FROM g WINDOW w AS (PARTITION BY c))
SELECT c AS case_id, CASE WHEN z = 1 THEN u WHEN n / a >= 0.6 THEN m ELSE u END AS domain, z = 1 OR n / a < 0.6 AS kept FROM h WHERE k = 1""")
def domain_votes(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("domain"), "o_orderstatus").agg((F.sum("o_totalprice") / 1e6).alias("score"))
    return routing.domain_votes(o.withColumn("current", F.min("domain").over(Window.partitionBy("case_id"))).drop("o_orderstatus"))


@named("""WITH f AS (SELECT l_orderkey c, l_returnflag l, max(l_discount) s FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey c, l_returnflag l, max(l_tax) s FROM lineitem GROUP BY 1, 2),
x AS (SELECT f.c, f.l, f.s sf, g.s sc, max(g.s) OVER (PARTITION BY f.c) t, row_number() OVER (PARTITION BY f.c ORDER BY f.s DESC, f.l) k, (f.s + g.s) / 2 s FROM f JOIN g ON f.c = g.c AND f.l = g.l), y AS (SELECT *, max(s) FILTER (k > 1) OVER (PARTITION BY c) o FROM x)
SELECT c AS case_id, l AS label, round(s, 6) AS score, round(s - coalesce(o, 0), 6) AS margin FROM y WHERE k = 1 AND sc >= t - 0.015""")
def cross_view(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("label"), "l_discount", "l_tax")
    v = lambda c: x.groupBy("case_id", "label").agg(F.max(c).alias("score"))
    return routing.cross_view(v("l_discount"), v("l_tax")).select("case_id", "label", r6(F.col("score")).alias("score"), r6(F.col("margin")).alias("margin"))


@named("""WITH p AS (SELECT l_partkey e, max(l_returnflag) p, min(l_linestatus) t0, CASE WHEN min(l_linestatus) = 'F' THEN 'A' ELSE 'N' END t FROM lineitem GROUP BY 1), c AS (SELECT p, t, count(*) n FROM p GROUP BY 1, 2), l AS (SELECT p l FROM c UNION SELECT t FROM c),
g AS (SELECT l, coalesce(sum(n) FILTER (p = l AND t = l), 0) i, coalesce(sum(n) FILTER (p = l), 0) a, coalesce(sum(n) FILTER (t = l), 0) b FROM l, c GROUP BY 1) SELECT l AS label, round(i / (a + b - i), 6) AS iou, round(i / greatest(a, 1), 6) AS "precision", round(i / greatest(b, 1), 6) AS recall FROM g""")
def class_metrics(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("e")).agg(F.max("l_returnflag").alias("p"), F.when(F.min("l_linestatus") == "F", "A").otherwise("N").alias("t")).withColumn("case_id", F.lit(0))
    m = evaluation.class_metrics(x.select("case_id", "e", F.col("p").alias("label")), x.select("case_id", "e", F.col("t").alias("label")))
    return m.select("label", *(r6(F.col(k)).alias(k) for k in ("iou", "precision", "recall")))


@named("""WITH o AS (SELECT o_custkey r, count(DISTINCT o_orderkey) n, min(o_orderkey) i FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) SELECT c_custkey AS request, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, coalesce(n = 1 AND i % 2 = 0, false) AS correct FROM customer LEFT JOIN o ON r = c_custkey""")
def resolution_states(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("item"))
    even = o.where("item % 2 = 0").groupBy("request").agg(F.min("item").alias("target"))
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("request")).join(even, "request", "left")
    return evaluation.resolution_states(o, q)


@named(f"""WITH {_DELTA}, z AS (SELECT v, delta x, rank() OVER (PARTITION BY v ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY v, abs(delta)) - 1) / 2.0 r FROM d)
SELECT v AS variant, count(*) AS n, sum(CASE WHEN x > 0 THEN r WHEN x = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN x < 0 THEN r WHEN x = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_minus, round((sum(CASE WHEN x > 0 THEN r WHEN x < 0 THEN -r ELSE 0 END) / sqrt(sum(r * r)))::DOUBLE, 6) AS z FROM z GROUP BY 1""")
def signed_ranks(spark, d):
    return evaluation.signed_ranks(_deltas(spark, d), "variant", "delta").select("variant", "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), r6(F.col("z")).alias("z"))


@named("""WITH t AS (SELECT unnest([0.02, 0.05, 0.08]) t) SELECT t::DOUBLE AS threshold, round(count(*) FILTER (l_discount >= t AND l_returnflag = 'R') / count(*) FILTER (l_discount >= t OR l_returnflag = 'R'), 6) AS iou, round(count(*) FILTER (l_discount >= t AND l_returnflag <> 'R') / count(*), 6) AS false_share FROM lineitem, t GROUP BY 1""")
def probability_thresholds(spark, d):
    x = evaluation.probability_thresholds(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R", [0.02, 0.05, 0.08])
    return x.select("threshold", r6(F.col("iou")).alias("iou"), r6(F.col("false_share")).alias("false_share"))
