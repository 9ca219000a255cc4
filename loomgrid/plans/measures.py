"""Queries of evaluation, validation, retrieval and ontology operators over the driver tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text, vectors
from ..operators import assignment, evaluation, graph, ordered, overlap, ownership, priors, regions, retrieval, routing, validation
from ..sources import readers, writers
from ..storage import table
from . import hypotheses as hy
from .catalog import _SIM, _W, _hits, named, r6, word_sets

# -- names and numbers --


@named("""SELECT p_partkey, lower(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')) AS slug, CASE WHEN p_type LIKE '% %' THEN regexp_replace(p_type, ' [^ ]*$', '') ELSE p_type END AS family, CASE WHEN starts_with(p_type, 'ECONOMY ') THEN substr(p_type, 9) ELSE p_type END AS bare,
regexp_matches(p_type || '_' || (['body', 'panel', 'wheel', 'frame', 'x'])[p_size % 5 + 1], '_(body|panel|frame)$') AS broad FROM part""")
def name_functions(spark, d):
    """SF6, SF7, PF5: slugs, prefixes and broad names."""
    ends = F.element_at(F.array(*map(F.lit, ("body", "panel", "wheel", "frame", "x"))), F.col("p_size") % 5 + 1)
    p = table(spark, d, "part")
    return p.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.before_last(F.col("p_type"), " ").alias("family"), text.without_prefix(F.col("p_type"), F.lit("ECONOMY ")).alias("bare"), scores.broad_host(F.concat("p_type", F.lit("_"), ends)).alias("broad"))


@named("""WITH x AS (SELECT s_suppkey k, 'org/grounding-DINO-' || (['tiny', 'base', 'large'])[s_suppkey % 3 + 1] || '/mask' src, CASE WHEN s_suppkey % 4 = 0 THEN ' own ' ELSE '' END dec, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 7 END i, CASE WHEN s_suppkey % 2 = 0 THEN 'auto' END o FROM supplier)
SELECT k AS s_suppkey, regexp_replace(coalesce(nullif(trim(dec), ''), 'org/grounding-DINO-' || (['tiny', 'base', 'large'])[k % 3 + 1]), 'grounding-dino-(tiny|base)', 'grounding-dino', 'i') AS family, coalesce(o, 'legacy') || '::' || i AS root, coalesce(o, 'legacy') || '::' || coalesce(i::VARCHAR, 'unknown') AS shown,
coalesce(CASE WHEN k % 6 = 0 THEN 'scene::' || k END, coalesce(o, 'legacy') || '::' || i, 'unscoped') AS scope FROM x""")
def key_functions(spark, d):
    """PF2, PF3, PF4: families, root keys under their null rules, identity scopes."""
    k = F.col("s_suppkey")
    size = F.element_at(F.array(*map(F.lit, ("tiny", "base", "large"))), (k % 3 + 1).cast("int"))
    src, index, origin = F.concat(F.lit("org/grounding-DINO-"), size, F.lit("/mask")), F.when(k % 5 != 0, k % 7), F.when(k % 2 == 0, "auto")
    root = scores.root_key(origin, index)
    return table(spark, d, "supplier").select("s_suppkey", scores.source_family(src, F.when(k % 4 == 0, " own ").otherwise("")).alias("family"), root.alias("root"), scores.root_label(origin, index, "unknown").alias("shown"), scores.scope_key(F.when(k % 6 == 0, k.cast("string")), root).alias("scope"))


@named("""WITH h AS (SELECT *, sha256('seed:' || o_orderkey) h, o_totalprice / 612347 f FROM orders)
SELECT o_orderkey, round((('0x' || substr(h, 1, 8))::BIGINT * 4294967296.0 + ('0x' || substr(h, 9, 8))::BIGINT) / 18446744073709551616.0, 6) AS fraction, lpad(round_even(f * 100, 0)::INT::VARCHAR, 3, '0') AS threshold, (o_orderkey % 3, o_custkey % 11, o_orderkey % 2) >= (1, 5, 0) AS newer,
round(CASE WHEN f BETWEEN 0.1 AND 0.5 THEN 1 WHEN f < 0.1 THEN greatest(0, f / 0.1) ELSE greatest(0, 0.5 / f) END, 6) AS prior, o_custkey % 90 > 0 AND o_custkey % 90 < greatest(4 * 10, round_even(600 * 0.05, 0)) AND (o_custkey % 90) / 100 < 0.3 AS sliver,
CASE WHEN o_custkey % 40 < 30 AND o_custkey % 40 > 0 AND 50 + o_orderkey % 30 - o_custkey % 40 > 25 THEN CASE WHEN 20 - 10 >= 25 THEN 'center' WHEN abs((o_custkey % 40) - 20) <= 1.6 THEN 'center' WHEN (o_custkey % 40) < 20 THEN 'left' ELSE 'right' END ELSE 'skip' END AS side FROM h""".replace("""CASE WHEN o_custkey % 40 < 30 AND o_custkey % 40 > 0 AND 50 + o_orderkey % 30 - o_custkey % 40 > 25 THEN CASE WHEN 20 - 10 >= 25 THEN 'center' WHEN abs((o_custkey % 40) - 20) <= 1.6 THEN 'center' WHEN (o_custkey % 40) < 20 THEN 'left' ELSE 'right' END ELSE 'skip' END AS side""", """CASE WHEN o_orderkey % 7 * 3 < 20 AND o_orderkey % 7 * 3 + o_custkey % 25 > 20 THEN 'center' WHEN abs(o_custkey % 40 - 20) <= 1.6 THEN 'center' WHEN o_custkey % 40 < 20 THEN 'left' ELSE 'right' END AS side"""))
def number_functions(spark, d):
    """SF15, SF17, SF19, PF18, PF19, PF25: hash fractions, versions, threshold keys, slivers, sides, area priors."""
    o, c, f = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 612347
    version = F.concat_ws(".", (o % 3).cast("string"), (c % 11).cast("string"), (o % 2).cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", r6(scores.hash_fraction(o, "seed")).alias("fraction"), scores.threshold_key(f).alias("threshold"), scores.version_at_least(version, "1.5").alias("newer"), r6(scores.area_prior(f, F.lit(0.1), F.lit(0.5))).alias("prior"),
        scores.visibility_sliver(c % 90, F.lit(100), F.lit(600), 10, 0.05, 0.3).alias("sliver"), scores.side(c % 40, F.lit(20), F.lit(40), o % 7 * 3, o % 7 * 3 + c % 25).alias("side"),
    )


@named("""WITH b AS (SELECT o_orderkey k, o_orderkey % 2 = 0 n, o_custkey % 1100 - 50.5 x0, o_custkey % 700 + 0.5 y0, (o_custkey % 1100) + (o_orderkey % 300) - 30.25 x1, o_custkey % 700 + o_orderkey % 200 + 1.75 y1 FROM orders), c AS (SELECT k, greatest(0, least(640, round_even(x0 * CASE WHEN n THEN 640 / 1000 ELSE 1 END, 0)::INT)) x0, greatest(0, least(480, round_even(y0 * CASE WHEN n THEN 480 / 1000 ELSE 1 END, 0)::INT)) y0,
greatest(0, least(640, round_even(x1 * CASE WHEN n THEN 640 / 1000 ELSE 1 END, 0)::INT)) x1, greatest(0, least(480, round_even(y1 * CASE WHEN n THEN 480 / 1000 ELSE 1 END, 0)::INT)) y1 FROM b) SELECT k AS o_orderkey, x0, y0, x1, y1 FROM c WHERE x1 > x0 AND y1 > y0""")
def image_boxes(spark, d):
    """SF18: boxes in thousandths or pixels, cut to the image; empty ones go."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    box = F.array(c % 1100 - 50.5, c % 700 + 0.5, c % 1100 + o % 300 - 30.25, c % 700 + o % 200 + 1.75).cast("array<double>")
    x = table(spark, d, "orders").select("o_orderkey", scores.image_box(box, F.when(o % 2 == 0, "normalized_1000").otherwise("pixels"), F.lit(640), F.lit(480)).alias("b"))
    return x.where("b IS NOT NULL").select("o_orderkey", "b.*")


@named("""SELECT s_suppkey, coalesce(s_suppkey % 3 <> 0 AND (s_suppkey % 4 = 0 OR s_acctbal / 20000 >= 0.24), false) AS broad FROM supplier""")
def scene_layers(spark, d):
    """PF9: broad scene layers by nested metadata."""
    k = F.col("s_suppkey")
    meta = F.struct(F.when(k % 3 != 0, "scene_layer").alias("role"), F.struct((k % 4 == 0).alias("derived"), (F.col("s_acctbal") / 20000).alias("area")).alias("evidence"))
    return table(spark, d, "supplier").withColumn("m", meta).select("s_suppkey", scores.broad_scene_layer(F.col("m.role"), F.col("m.evidence.derived"), F.col("m.evidence.area")).alias("broad"))


@named("""WITH g AS (SELECT s_nationkey k, list(lower(s_name) ORDER BY s_suppkey) n FROM supplier GROUP BY 1) SELECT k AS s_nationkey, 'Object: thing (n' || k || ')' || chr(10) || 'Known parts:' || chr(10) || array_to_string(list_transform(n, lambda x: '- ' || x || ': a, b, c'), chr(10)) || chr(10) || 'Name the visible physical parts that are missing.' AS prompt FROM g""")
def inventory_prompts(spark, d):
    """SF9, SO5: prompts with an inventory."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", F.lower("s_name").alias("n")))), lambda s: s["n"])
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(names.alias("n"))
    aliases = F.transform("n", lambda _: F.array(*map(F.lit, "abcd")))
    return g.select("s_nationkey", text.inventory_prompt(F.lit("thing"), F.concat(F.lit("n"), F.col("s_nationkey")), F.col("n"), aliases).alias("prompt"))


@named("""SELECT p_partkey, CASE WHEN n = 1 THEN b ELSE b || '_' || n END AS slug_id FROM (SELECT p_partkey, lower(p_brand) b, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) n FROM part)""")
def slug_ids(spark, d):
    """WN8: repeated slugs get numbers."""
    return regions.slug_ids(table(spark, d, "part").withColumn("slug", F.lower("p_brand")), [], "slug", "p_partkey").select("p_partkey", "slug_id")


@named("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props::JSON->>'k')::BIGINT END AS k FROM events""")
def embedded_json(spark, d):
    """SF8: the first JSON object of a free text."""
    c = F.when(F.col("event_id") % 5 == 0, "no {object here").otherwise(F.concat(F.lit("so {x, "), F.col("props"), F.lit(" and {more")))
    return table(spark, d, "events").select("event_id", F.get_json_object(text.first_json_object(c), "$.k").cast("long").alias("k"))


@named("""SELECT p_partkey, CASE p_mfgr WHEN 'Manufacturer#1' THEN 'first' ELSE CASE p_brand WHEN 'Brand#22' THEN 'second' ELSE p_brand END END AS canonical FROM part""".replace("CASE p_mfgr WHEN 'Manufacturer#1' THEN 'first' ELSE CASE p_brand WHEN 'Brand#22' THEN 'second' ELSE p_brand END END", "CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#22' THEN 'second' ELSE p_brand END"))
def aliases(spark, d):
    """SF4: aliases of a category before those of a domain."""
    return table(spark, d, "part").select("p_partkey", regions.canonical(F.col("p_brand"), {"Brand#11": "first"}, {"Brand#11": "later", "Brand#22": "second"}).alias("canonical"))


@named("""SELECT vec_id, round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-16), 5) AS cosine FROM (SELECT e.vec_id, list_transform(e.embedding, lambda x, i: x::DOUBLE * (i % 3 + 1)) a, list_transform(f.embedding, lambda x, i: x::DOUBLE * (i % 3 + 1)) b FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1)""")
def metric_cosine(spark, d):
    """SF12: cosine under a diagonal metric."""
    e = table(spark, d, "embeddings")
    w = F.transform(F.col("embedding"), lambda x, i: ((i + 1) % 3 + 1).cast("double"))
    x = e.select("vec_id", vectors.weighted(F.col("embedding"), w).alias("a"))
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return x.join(y, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


@named("""WITH p AS (SELECT p_partkey k, 1 + p_partkey % 4 g, p_size / 50.0 x, p_retailprice / 2000 y FROM part), s(g, a, b) AS (VALUES (1, 0.2, 0.5), (1, 0.7, 0.6), (2, 0.5, 0.6), (3, 0.9, 0.8), (4, 0.1, 0.5)),
z AS (SELECT k, min((((x - a) / 0.1) ** 2 + ((y - b) / 0.2) ** 2) / 2) u, min((((1 - x - a) / 0.1) ** 2 + ((y - b) / 0.2) ** 2) / 2) v FROM p JOIN s USING (g) GROUP BY 1) SELECT k AS p_partkey, round(greatest(exp(-0.5 * u), exp(-0.5 * v)), 6) AS compatibility FROM z""")
def mirrored_compatibility(spark, d):
    """SF13: geometry against samples, or mirrored."""
    lists = [[[0.2, 0.5], [0.7, 0.6]], [[0.5, 0.6]], [[0.9, 0.8]], [[0.1, 0.5]]]
    samples = F.element_at(F.array(*(F.array(*(F.array(*map(F.lit, s)) for s in x)) for x in lists)), (F.col("p_partkey") % 4 + 1).cast("int"))
    g = F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000)
    return table(spark, d, "part").select("p_partkey", r6(priors.compatibility(g, samples, F.array(F.lit(0.1), F.lit(0.2)))).alias("compatibility"))


@named("""WITH c AS (SELECT p_partkey i, l, (p_size * l % 17 + 1) / 20.0 p, l % 2 q FROM part, (VALUES (1), (2), (3), (4)) v(l)), h AS (SELECT p_partkey i, q, (p_size % 9 + q + 1) / 12.0 pp FROM part, (VALUES (0), (1)) v(q)), z AS (SELECT c.i, l, ln(p) + 0.6 * ln(pp) z FROM c JOIN h ON h.i = c.i AND h.q = c.q)
SELECT i AS p_partkey, l AS label, round(exp(z - max(z) OVER (PARTITION BY i)) / sum(exp(z - m)) OVER (PARTITION BY i), 6) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY i) m FROM z)""")
def conditioned_labels(spark, d):
    """SF14: labels under their parents' probabilities."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size")
    c = p.withColumn("label", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).select("item", "label", (F.col("label") % 2).alias("parent"), ((F.col("p_size") * F.col("label") % 17 + 1) / 20.0).alias("p"))
    h = p.withColumn("parent", F.explode(F.array(F.lit(0), F.lit(1)))).select("item", "parent", ((F.col("p_size") % 9 + F.col("parent") + 1) / 12.0).alias("p"))
    return regions.conditioned(c, h, 0.6).select(F.col("item").alias("p_partkey"), "label", r6(F.col("probability")).alias("probability"))


@named("""WITH f AS (SELECT vec_id, label, (('0x' || substr(sha256('split:' || vec_id), 1, 8))::BIGINT * 4294967296.0 + ('0x' || substr(sha256('split:' || vec_id), 9, 8))::BIGINT) / 18446744073709551616.0 h FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) n, count(*) OVER (PARTITION BY label) c FROM f)
SELECT vec_id, n <= greatest(1, round_even(c * 0.2, 0)) AS holdout FROM n""")
def hashed_split(spark, d):
    """SF16: a stable share of each label, by hash fraction."""
    return evaluation.stratified_holdout(table(spark, d, "embeddings"), "label", "vec_id", 0.2, "split").select("vec_id", "holdout")


# -- retrieval and routing --


@named(f"""WITH {_SIM}, n AS (SELECT u.vec_id, p.label, i.vec_id a, list_dot_product(u.v, i.v) s FROM u JOIN p ON true JOIN u i ON i.label = p.label AND i.vec_id < 40 WHERE u.vec_id % 10 = 0), t AS (SELECT vec_id, label, avg(s) m FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY s DESC, a DESC) k FROM n) WHERE k <= 3 GROUP BY 1, 2)
SELECT vec_id, label, round(0.7 * s + 0.3 * m, 5) AS score FROM s JOIN t USING (vec_id, label)""")
def blended_labels(spark, d):
    """AG11: label scores with the nearest reviewed assets of the label. The first forty vectors are the reviewed index;
    every tenth is a query."""
    e = table(spark, d, "embeddings")
    index = e.where("vec_id < 40").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    near = retrieval.similar(asked, index, 40)
    s = _hits(spark, d).select("query", "label", F.col("similarity").alias("score"))
    return retrieval.blended(near, s).select(F.col("query").alias("vec_id"), "label", F.round("score", 5).alias("score"))


@named(f"""WITH {_SIM}, a AS (SELECT vec_id, label, s + CASE WHEN label % 3 = 0 THEN 0.02 ELSE 0 END + CASE WHEN label % 4 = 0 THEN 0.01 ELSE 0 END x, (label + vec_id) % 3 <> 0 c FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, label) n FROM a),
m AS (SELECT *, x - CASE WHEN n = 1 THEN max(CASE WHEN n = 2 THEN x END) OVER w ELSE max(CASE WHEN n = 1 THEN x END) OVER w END g FROM r WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, label, round(x, 5) AS score, round(g, 5) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, label) k FROM m WHERE c) WHERE k = 1""")
def label_alternatives(spark, d):
    """WN16: the best compatible label, its margin against all labels."""
    x = _hits(spark, d).select(F.col("query").alias("region"), "label", "similarity", F.when(F.col("label") % 3 == 0, 0.02).alias("shape"), F.when(F.col("label") % 4 == 0, 0.01).alias("axis"), ((F.col("label") + F.col("query")) % 3 != 0).alias("compatible"))
    return retrieval.alternatives(x).where("rank = 1").select(F.col("region").alias("vec_id"), "label", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"))


@named(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) n, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) s2 FROM s), f AS (SELECT *, 'd' || label % 2 dm FROM r WHERE n <= 4), t AS (SELECT vec_id, dm, s, s - s2 mg, s - s2 >= 0.2 ac FROM f WHERE n = 1), gg AS (SELECT f.vec_id, avg((f.dm = t.dm)::INT) su FROM f JOIN t USING (vec_id) GROUP BY 1)
SELECT vec_id, CASE WHEN ac OR (s >= 0.1 AND mg >= 0.01 AND su >= 0.75) THEN dm END AS domain, round(su, 6) AS support, CASE WHEN ac THEN 'accepted_exact_full_image_domain' WHEN s >= 0.1 AND mg >= 0.01 AND su >= 0.75 THEN 'accepted_near_threshold_domain_consensus' ELSE 'insufficient_full_image_domain_evidence' END AS reason FROM t JOIN gg USING (vec_id)""")
def domain_prior(spark, d):
    """WN14: a domain prior from an ambiguous route."""
    h = _hits(spark, d)
    w = Window.partitionBy("query").orderBy("rank")
    x = h.withColumn("margin", F.col("similarity") - F.lead("similarity").over(w))
    x = x.select(F.col("query").alias("case_id"), "rank", F.concat(F.lit("d"), F.col("label") % 2).alias("domain"), F.col("similarity").alias("score"), "margin", (F.col("margin") >= 0.2).alias("accepted"))
    return routing.domain_prior(x, 0.1, 0.01, 0.75, 4).select(F.col("case_id").alias("vec_id"), "domain", r6(F.col("support")).alias("support"), "reason")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@named(f"""WITH p AS (SELECT DISTINCT {_NORM.format('p_type')} q FROM part), a AS (SELECT DISTINCT {_NORM.format("split_part(p_type, ' ', 3)")} a, split_part(p_type, ' ', 3) l, 'd' || length(split_part(p_type, ' ', 3)) % 2 d FROM part WHERE p_type LIKE '% % %' UNION SELECT DISTINCT {_NORM.format('p_type')}, p_type, 'whole' FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT *, CASE WHEN q = a THEN 1.0 ELSE 0.84 + 0.08 * len(string_split(a, ' ')) / len(string_split(q, ' ')) END::DOUBLE s FROM p, a WHERE contains(' ' || q || ' ', ' ' || a || ' ') AND a <> ''),
t AS (SELECT *, max(s) OVER (PARTITION BY q) m, row_number() OVER (PARTITION BY q ORDER BY s DESC, len(string_split(a, ' ')) DESC, l DESC) k FROM x), g AS (SELECT q, count(DISTINCT d) = 1 r FROM t WHERE s = m GROUP BY 1) SELECT q AS prompt, l AS label, d AS domain, round(s, 6) AS score, r AS resolved FROM t JOIN g USING (q) WHERE k = 1""")
def prompt_resolution(spark, d):
    """JN14: prompts by whole aliases or contained ones."""
    p = table(spark, d, "part")
    last = F.element_at(F.split("p_type", " "), 3)
    a = p.where("p_type LIKE '% % %'").select(text.normalize(last).alias("alias"), last.alias("label"), F.concat(F.lit("d"), F.length(last) % 2).alias("domain"))
    a = a.unionByName(p.where("p_partkey % 2 = 0").select(text.normalize(F.col("p_type")).alias("alias"), F.col("p_type").alias("label"), F.lit("whole").alias("domain")))
    return routing.resolve_prompts(p.select(text.normalize(F.col("p_type")).alias("prompt")), a).withColumn("score", r6(F.col("score")))


# -- ontology --

_ONT = "t AS (SELECT s_suppkey // 3 p, s_suppkey c FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey // 5 + 1, s_suppkey FROM supplier WHERE s_suppkey // 5 + 1 < s_suppkey)"


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey > 0").select(F.floor(k / 3).alias("parent"), k.alias("child"))
    return a.unionByName(s.select((F.floor(k / 5) + 1).alias("parent"), k.alias("child")).where("parent < child"))


@named(f"""WITH RECURSIVE {_ONT}, r AS (SELECT p n, 0 k FROM t WHERE p NOT IN (SELECT c FROM t) UNION SELECT c, k + 1 FROM r JOIN t ON t.p = r.n), m AS (SELECT n, max(k) k FROM r GROUP BY 1) SELECT n AS node, k AS depth, row_number() OVER (ORDER BY k, n) AS place FROM m""")
def class_order(spark, d):
    """GR8: classes after what they depend on, with further links of candidates."""
    s = _ontology(spark, d)
    return graph.class_order(s.where("parent = floor(child / 3)"), s.where("parent <> floor(child / 3)"))


@named(f"""WITH RECURSIVE {_ONT}, r AS (SELECT s_suppkey n FROM supplier WHERE s_suppkey % 17 = 0 UNION SELECT p FROM r JOIN t ON t.c = r.n) SELECT n AS node FROM r""")
def ancestor_closure(spark, d):
    """GR9: a selection with all that it needs over two kinds of links."""
    return graph.closure(_ontology(spark, d), table(spark, d, "supplier").where("s_suppkey % 17 = 0").select(F.col("s_suppkey").alias("node")))


@named("""WITH RECURSIVE t AS (SELECT s_suppkey c, CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey + 3 ELSE s_suppkey - 1 END p FROM supplier WHERE s_suppkey % 10 <> 5), r AS (SELECT c n, c w, 0 k, [c] seen FROM t UNION ALL SELECT n, p, k + 1, list_append(seen, p) FROM r JOIN t ON t.c = r.w WHERE NOT list_contains(list_slice(seen, 1, len(seen) - 1), r.w)),
m AS (SELECT n, max(k) k FROM r GROUP BY 1) SELECT n AS node, k AS depth FROM m UNION SELECT p, 0 FROM t WHERE p NOT IN (SELECT c FROM t)""")
def safe_depths(spark, d):
    """GR10: depths along one parent each; a way that comes back counts until then."""
    k = F.col("s_suppkey")
    return graph.safe_depths(table(spark, d, "supplier").where("s_suppkey % 10 <> 5").select(F.when(k % 10 == 1, k + 3).otherwise(k - 1).alias("parent"), k.alias("child")))


# -- clusters, groups, priors --

_NEAR = f"{_W}, nr AS (SELECT a, b, iou, x.lang || ':' || x.source c FROM m JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE iou >= 0.3 AND x.lang = y.lang AND x.source = y.source), li AS (SELECT a i, c FROM nr UNION SELECT b, c FROM nr), sy AS (SELECT a i, b j, iou f FROM nr UNION ALL SELECT b, a, iou FROM nr), od AS (SELECT li.*, row_number() OVER (ORDER BY i) o, (SELECT list({{'j': j, 'f': f}}) FROM sy WHERE sy.i = li.i) nb FROM li)"


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    case = F.concat_ws(":", "lang", "source")
    key = lambda k: docs.select(F.col("doc_id").alias(k), case.alias(f"c{k}"))
    p = overlap.set_pairs(word_sets(spark, d), 0.3).join(key("a"), "a").join(key("b"), "b").where("ca = cb")
    near = p.select(F.col("ca").alias("case_id"), "a", "b", F.col("iou").alias("affinity"))
    items = docs.select(case.alias("case_id"), F.col("doc_id").alias("item"), F.col("doc_id").alias("place"), F.col("n_chars").alias("area"))
    return items.join(near.select("case_id", F.explode(F.array("a", "b")).alias("item")).distinct(), ["case_id", "item"], "left_semi"), near


@named(f"""WITH RECURSIVE {_NEAR}, g AS (SELECT 0::BIGINT k, []::BIGINT[] an, NULL::BIGINT i, NULL::BIGINT to_ UNION ALL
SELECT k + 1, CASE WHEN h IS NULL THEN list_append(an, n_i) ELSE an END, n_i, coalesce(h, n_i) FROM (SELECT g.k, g.an, od.i n_i, (list_sort(list_transform(list_filter(od.nb, lambda x: x.f >= 0.5 AND list_contains(g.an, x.j)), lambda x: {{'f': x.f, 'p': list_position(g.an, x.j), 'j': x.j}}), 'DESC'))[1].j h FROM g JOIN od ON od.o = g.k + 1)),
a AS (SELECT i, to_, c, dense_rank() OVER (PARTITION BY c ORDER BY to_) - 1 n FROM g JOIN li USING (i)) SELECT c AS case_id, i AS item, n AS cluster FROM a""")
def anchor_groups(spark, d):
    """GR4: each item joins the cluster whose first member is nearest."""
    items, near = _near(spark, d)
    return ordered.anchor_clusters(items, near, 0.5)


@named(f"""WITH RECURSIVE {_NEAR}, g AS (SELECT 0::BIGINT k, []::BIGINT[] ids, []::BIGINT[] cl, NULL::BIGINT i, NULL::BIGINT to_ UNION ALL
SELECT k + 1, list_append(ids, n_i), list_append(cl, coalesce(h, n_i)), n_i, coalesce(h, n_i) FROM (SELECT g.k, g.ids, g.cl, od.i n_i, list_min(list_transform(list_filter(od.nb, lambda x: x.f >= 0.5 AND list_contains(g.ids, x.j)), lambda x: g.cl[list_position(g.ids, x.j)])) h FROM g JOIN od ON od.o = g.k + 1)),
a AS (SELECT i, to_, c, dense_rank() OVER (PARTITION BY c ORDER BY to_) - 1 n FROM g JOIN li USING (i)) SELECT c AS case_id, i AS item, n AS cluster FROM a""")
def first_match_groups(spark, d):
    """GR5: each item joins the first cluster with a near member."""
    items, near = _near(spark, d)
    return ordered.first_match_clusters(items, near, 0.5)


@named()
def bounded_groups(spark, d):
    """GR3: unions that keep areas alike."""
    items, near = _near(spark, d)
    return ordered.bounded_clusters(items, near, 0.5)


@named("""SELECT o_custkey AS cluster, o_orderkey AS item, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderkey) n FROM (SELECT *, 0.6 * o_totalprice / 600000 + 0.24 * (o_orderkey % 10) / 10 + 0.16 * (o_orderkey % 7) / 7 v FROM orders)) WHERE n = 1""")
def representatives(spark, d):
    """GR6: the view that stands for a cluster."""
    o = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), o.alias("item"), (F.col("o_totalprice") / 600000).alias("score"), (o % 10 / 10).alias("agreement"), (o % 7 / 7).alias("edge"))
    return regions.representatives(x).select("cluster", "item", r6(F.col("value")).alias("value"))


@named(f"""WITH {hy._E}, {hy._G}, r AS (SELECT s // {hy.CASE} q, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, sum(area) a FROM gm GROUP BY 1) SELECT s AS set_id, round(((gm.x0 + gm.x1) / 2 - r.x0) / (r.x1 - r.x0), 6) AS rel_cx, round((gm.y1 - gm.y0) / greatest(r.y1 - r.y0, 1), 6) AS rel_h, round(area / r.a, 6) AS rel_area FROM gm JOIN r ON r.q = gm.s // {hy.CASE}""")
def relative_geometry(spark, d):
    """AG6: geometry of parts inside their root."""
    g = hy.geometry(spark, d)
    r = g.groupBy("case_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))
    return ownership.relative_geometry(g, r).select("set_id", *(r6(F.col(k)).alias(k) for k in ("rel_cx", "rel_h", "rel_area")))


@named("""WITH a AS (SELECT p_type n, count(*) / (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) p, count(DISTINCT p_brand) s, list(p_partkey ORDER BY p_partkey)[1:3] l FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_type n, count(*) / (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) p, count(DISTINCT p_size) s, list(p_partkey ORDER BY p_partkey)[1:3] l FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT coalesce(a.n, b.n) AS name, round(greatest(a.p, b.p), 6) AS prevalence, greatest(a.s, b.s) AS support, array_to_string(list_concat(coalesce(a.l, []), list_filter(coalesce(b.l, []), lambda x: NOT list_contains(coalesce(a.l, []), x))), ',') AS samples FROM a FULL JOIN b ON a.n = b.n""")
def merged_priors(spark, d):
    """AG8: priors of two sources."""
    p = table(spark, d, "part")

    def side(rows: DataFrame, key: str) -> DataFrame:
        of = max(rows.count(), 1)
        first = F.slice(F.sort_array(F.collect_list("p_partkey")), 1, 3)
        return rows.groupBy(F.col("p_type").alias("name")).agg((F.count(F.lit(1)) / of).alias("prevalence"), F.countDistinct(key).alias("support"), first.alias("samples"))

    m = priors.merge(side(p.where("p_partkey % 2 = 0"), "p_brand"), side(p.where("p_partkey % 3 = 0"), "p_size"))
    return m.select("name", r6(F.col("prevalence")).alias("prevalence"), "support", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@named("""WITH g AS (SELECT s_nationkey c, 'a' || s_suppkey % 2 a, 'n' || s_suppkey % 3 n, list(s_suppkey ORDER BY s_acctbal, s_suppkey) m, min(s_suppkey % 20) x0, max(s_suppkey % 20 + 5) x1, sum(s_suppkey % 30) ar FROM supplier GROUP BY 1, 2, 3) SELECT c AS case_id, a AS asset_id, n AS semantic, array_to_string(m, ',') AS members, x0, x1, ar::BIGINT AS area FROM g""")
def part_groups(spark, d):
    """AG28: parts of one asset and name as a group."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(F.col("s_nationkey").alias("case_id"), F.concat(F.lit("a"), k % 2).alias("asset_id"), F.concat(F.lit("n"), k % 3).alias("semantic"), F.col("s_acctbal").alias("instance_index"), k.alias("part_id"), (k % 20).alias("x0"), (k % 20).alias("y0"), (k % 20 + 5).alias("x1"), (k % 20 + 5).alias("y1"), (k % 30).alias("area"))
    return regions.groups(x).select("case_id", "asset_id", "semantic", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "bbox.x0", "bbox.x1", "area")


@named("""WITH e AS (SELECT o_custkey % 4 c, o_orderpriority g, o_orderstatus p, count(*) n FROM orders GROUP BY 1, 2, 3), s AS (SELECT * FROM e WHERE p = 'O' OR g < '4'), b AS (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY n DESC, g) k FROM s) SELECT c AS case_id, p AS part_id, arg_min(g, (-n, g)) AS best FROM s GROUP BY 1, 2""")
def rebound_parts(spark, d):
    """AG29: after the groups have claimed their parts, the group of greatest overlap for each part."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 4).alias("case_id"), F.col("o_orderpriority").alias("group_id"), F.col("o_orderstatus").alias("part_id")).agg(F.count(F.lit(1)).alias("n")).where("part_id = 'O' OR group_id < '4'")
    claimed = regions.rebind(o).join(o, ["case_id", "group_id", "part_id"])
    # every part is bound; the group that overlaps it most comes from the table of overlaps
    best = o.join(claimed.select("case_id", "part_id").distinct(), ["case_id", "part_id"], "left_semi")
    return best.groupBy("case_id", "part_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "group_id")).alias("m")).select("case_id", "part_id", F.col("m.group_id").alias("best"))


@named("""WITH d AS (SELECT DISTINCT o_custkey k, o_totalprice v FROM orders), g AS (SELECT *, ln(v) - ln(lag(v) OVER (PARTITION BY k ORDER BY v)) g FROM d), c AS (SELECT k, arg_max(v, (g, -v)) c FROM g WHERE g >= 0.7 GROUP BY 1) SELECT o_orderkey, CASE WHEN o_totalprice >= c THEN 'high' ELSE 'low' END AS side FROM orders LEFT JOIN c ON k = o_custkey""")
def log_gaps(spark, d):
    """WN11: the two modes of a customer's prices."""
    return regions.log_gap_split(table(spark, d, "orders"), "o_custkey", "o_totalprice", 0.7).select("o_orderkey", "side")


@named("""WITH r AS (SELECT s_suppkey k, s_nationkey % 5 r, 'n' || s_suppkey % 4 n, s_suppkey % 3 = 0 g FROM supplier), n AS (SELECT r FROM r WHERE NOT g GROUP BY 1 HAVING count(DISTINCT n) >= 3) SELECT k AS s_suppkey FROM r WHERE NOT (g AND r IN (SELECT r FROM n))""")
def ensemble_gate(spark, d):
    """PF15: generic regions go where a root has enough names."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k, (F.col("s_nationkey") % 5).alias("root"), F.concat(F.lit("n"), k % 4).alias("semantic"), (k % 3 == 0).alias("generic"))
    return regions.ensemble_gate(x, 3).select("s_suppkey")


@named(f"""WITH {hy._E}, k AS (SELECT s, count(*) a, var_pop(e % 64) va, var_pop(e // 64) vb, covar_pop(e % 64, e // 64) vc FROM e WHERE e % 64 < 10 + s % 40 GROUP BY 1), m AS (SELECT *, sqrt(((va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + vc ** 2) + 1e-6) / greatest((va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + vc ** 2) + 1e-6, 1e-6)) el FROM k)
SELECT s AS set_id, round(el, 5) AS elongation, CASE WHEN a / 2000 < 0.015 THEN 'detail' WHEN el >= 1.6 THEN 'strip' ELSE 'panel' END AS kind FROM m""")
def region_kinds(spark, d):
    """PF20: details, strips and panels."""
    e = hy.elements(spark, d).where(F.col("e") % 64 < 10 + F.col("set_id") % 40)
    x = regions.shape(e, F.lit(64))
    return x.select("set_id", F.round("elongation", 5).alias("elongation"), regions.region_kind(F.col("area") / 2000, F.col("elongation"), strip=1.6).alias("kind"))


@named("""WITH q AS (SELECT l_suppkey % 7 c, l_partkey e, l_suppkey s, sum(l_quantity) q, bool_or(l_returnflag = 'R' AND l_discount >= 0.09) g FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT c, e, arg_max(s, (g, q, -s)) o FROM q GROUP BY 1, 2) SELECT c AS case_id, e, o AS owner FROM a JOIN (SELECT c, o FROM a GROUP BY 1, 2 HAVING count(*) >= 20) USING (c, o)""")
def gated_owner(spark, d):
    """AG3, AG4: owners with a gate, and without small ones."""
    gate = F.max((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09))
    q = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("case_id"), F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"), gate.alias("g"))
    return ownership.argmax_owner(q, ["case_id", "e"], "s", "q", F.col("g"), 20).select("case_id", "e", "owner")


@named("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, round(median(o_totalprice), 3) AS median, min(o_orderkey) AS first_key FROM orders GROUP BY 1""")
def named_aggregates(spark, d):
    """AG17: mean, sample deviation and median under names of their own."""
    v = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.stddev_samp(v), 3).alias("std"), F.round(F.percentile(v, F.lit(0.5)), 3).alias("median"), F.min("o_orderkey").alias("first_key"))


# -- evaluation --


@named(f"""WITH p AS (SELECT DISTINCT l_suppkey % 10 c, l_returnflag || l_linestatus n, l_partkey e FROM lineitem WHERE month(l_shipdate) > 6 AND NOT (l_returnflag = 'N' AND l_suppkey % 3 = 0)), t AS (SELECT DISTINCT l_suppkey % 10 c, CASE WHEN l_suppkey % 4 = 0 THEN 'XX' ELSE l_returnflag || l_linestatus END n, l_partkey e FROM lineitem WHERE month(l_shipdate) <= 6),
g AS (SELECT coalesce(p.c, t.c) c, coalesce(p.n, t.n) n, count(p.e) np, count(t.e) nt, count(*) FILTER (p.e IS NOT NULL AND t.e IS NOT NULL) i FROM p FULL JOIN t ON p.c = t.c AND p.n = t.n AND p.e = t.e GROUP BY 1, 2)
SELECT c AS case_id, round(count(*) FILTER (nt > 0 AND i / (np + nt - i) >= 0.1) / count(*) FILTER (nt > 0), 6) AS recall, round(count(*) FILTER (nt > 0 AND np > 0) / count(*) FILTER (np > 0), 6) AS "precision", round(avg(i / (np + nt - i)) FILTER (nt > 0), 6) AS mean_iou FROM g GROUP BY 1""")
def semantic_unions(spark, d):
    """AG25: unions of each name against the truth."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("case_id"), F.col("l_suppkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_partkey").alias("e"), (F.month("l_shipdate") <= 6).alias("first"))
    p = li.where("NOT first AND NOT (name LIKE 'N%' AND s % 3 = 0)")
    t = li.where("first").withColumn("name", F.when(F.col("s") % 4 == 0, "XX").otherwise(F.col("name")))
    x = evaluation.semantic_unions(p.select("case_id", "name", "e"), t.select("case_id", "name", "e"), 0.1)
    return x.select("case_id", *(r6(F.col(k)).alias(k) for k in ("recall", "precision", "mean_iou")))


@named("""SELECT count(*) AS cases, count(*) FILTER (o_orderstatus <> 'P') AS successes, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus <> 'P'), 0), 4) AS o_totalprice, round(coalesce(avg((o_orderkey % 2 = 0)::INT) FILTER (o_orderstatus <> 'P' AND o_orderkey % 3 <> 0), 0), 6) AS flag FROM orders""")
def macro_average(spark, d):
    """AG15, SC19: means over successful cases; flags only where they are known."""
    x = table(spark, d, "orders").withColumn("flag", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2 == 0))
    a = evaluation.macro_average(x, F.col("o_orderstatus") != "P", ["o_totalprice"], ["flag"])
    return a.select("cases", "successes", F.round("o_totalprice", 4).alias("o_totalprice"), r6(F.col("flag")).alias("flag"))


@named("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'routing_error' WHEN o_totalprice / 400000 < 0.25 THEN 'root_failure' WHEN o_totalprice / 400000 < 0.5 THEN 'weak_root' WHEN (o_custkey % 30) / 100 < 0.1 THEN 'part_discovery_failure' WHEN (o_custkey % 70) / 300 < 0.1 THEN 'semantic_assignment_failure' ELSE 'partial_or_strong_success' END AS class FROM orders""")
def failure_classes(spark, d):
    """PF22: the first stage that failed."""
    c = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", evaluation.failure_class(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 400000, c % 30 / 100, c % 70 / 300).alias("class"))


@named("""WITH v(variant, bonus, least) AS (VALUES ('A0', 0.0, 0.0), ('A1', 0.1, 0.0), ('A2', 0.1, 0.3), ('A3', 0.2, 0.3)) SELECT variant, s_nationkey, count(*) FILTER (s_acctbal / 10000 + bonus >= least) AS kept, round(avg(s_acctbal / 10000 + bonus), 6) AS mean FROM supplier, v GROUP BY 1, 2""")
def ablation_grid(spark, d):
    """EV11: every variant over every case."""
    v = {"A0": (0.0, 0.0), "A1": (0.1, 0.0), "A2": (0.1, 0.3), "A3": (0.2, 0.3)}
    x = evaluation.ablation(table(spark, d, "supplier"), {k: {"bonus": F.lit(b), "least": F.lit(m)} for k, (b, m) in v.items()})
    s = F.col("s_acctbal") / 10000 + F.col("bonus")
    return x.groupBy("variant", "s_nationkey").agg(F.count_if(s >= F.col("least")).alias("kept"), r6(F.avg(s)).alias("mean"))


@named("""WITH f AS (SELECT unnest([0.5, 1.0, 1.5]) f), v AS (SELECT 'iou__' || f || 'x' AS variant, 0.2 * f iou, 0.5 con FROM f UNION ALL SELECT 'con__' || f || 'x', 0.2, 0.5 * f FROM f) SELECT variant, count(*) FILTER (l_discount >= iou / 4 OR l_tax >= con / 8) AS kept FROM lineitem, v GROUP BY 1""")
def sensitivity_grid(spark, d):
    """EV12: one factor at a time."""
    grid = evaluation.sensitivity({"iou": 0.2, "con": 0.5}, [0.5, 1.0, 1.5])
    x = evaluation.ablation(table(spark, d, "lineitem").select("l_discount", "l_tax"), {g["variant"]: {k: F.lit(v) for k, v in g["values"].items()} for g in grid})
    return x.groupBy("variant").agg(F.count_if((F.col("l_discount") >= F.col("iou") / 4) | (F.col("l_tax") >= F.col("con") / 8)).alias("kept"))


@named("""WITH t AS (SELECT unnest([0.02, 0.05, 0.08]) t), x AS (SELECT t::DOUBLE t, count(*) FILTER (l_discount >= t AND l_returnflag = 'R') / count(*) FILTER (l_discount >= t OR l_returnflag = 'R') - 0.35 * count(*) FILTER (l_discount >= t AND l_returnflag <> 'R') / count(*) s FROM lineitem, t GROUP BY 1) SELECT t AS threshold, round(s, 6) AS score, t = (SELECT arg_max(t, (s, -t)) FROM x) AS chosen FROM x""")
def threshold_selection(spark, d):
    """EV16: the threshold of best score."""
    x = evaluation.threshold_selection(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R", [0.02, 0.05, 0.08])
    return x.select("threshold", r6(F.col("score")).alias("score"), "chosen")


@named("""WITH c AS (SELECT s_suppkey k, s_suppkey % 40 + 10 v, s_suppkey % 40 + 10 + s_suppkey % 13 f, s_suppkey % 9 a, least(s_suppkey % 9, s_suppkey % 13) h, s_suppkey % 40 + 10 - s_suppkey % 3 kv FROM supplier), m AS (SELECT *, kv + a c FROM c)
SELECT k AS case_id, round(v / f, 6) AS iou_before, round((kv + h) / (f + c - kv - h), 6) AS iou_after, round(CASE WHEN f = v THEN 1 ELSE h / (f - v) END, 6) AS hidden_recall, round(CASE WHEN a = 0 THEN 1 ELSE h / a END, 6) AS added_precision, round(kv / v, 6) AS visible_recall FROM m""")
def occlusion_metrics(spark, d):
    """EV17: completion against the truth."""
    k = F.col("s_suppkey")
    v, a = k % 40 + 10, k % 9
    f, h, kv = v + k % 13, F.least(k % 9, k % 13), v - k % 3
    x = table(spark, d, "supplier").select(k.alias("case_id"), v.alias("visible"), f.alias("full"), (kv + a).alias("completed"), (kv + h).alias("both_full"), h.alias("added_hidden"), kv.alias("kept_visible"))
    return evaluation.occlusion(x).select("case_id", *(r6(F.col(c)).alias(c) for c in ("iou_before", "iou_after", "hidden_recall", "added_precision", "visible_recall")))


@named("""WITH p AS (SELECT s_nationkey c, s_suppkey % 50 i, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 60 END r, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 8 END g FROM supplier), m AS (SELECT s_nationkey c, s_suppkey % 6 g, s_suppkey % 55 mm FROM supplier), u AS (SELECT DISTINCT c, i FROM p)
SELECT c AS case_id, count(i) - count(DISTINCT i) AS duplicate_ids, count(*) FILTER (r IS NOT NULL AND (c, r) NOT IN (SELECT (c, i) FROM u)) AS invalid_parents, count(*) FILTER (g IS NOT NULL AND (c, g) NOT IN (SELECT (c, g) FROM m)) AS unresolved_groups, coalesce((SELECT count(*) FROM m WHERE m.c = p.c AND (m.c, mm) NOT IN (SELECT (c, i) FROM u)), 0) AS invalid_members FROM p GROUP BY 1""")
def identity_audit(spark, d):
    """EV18: ids, parents, groups and members that don't resolve."""
    k, c = F.col("s_suppkey"), F.col("s_nationkey").alias("case_id")
    s = table(spark, d, "supplier")
    p = s.select(c, (k % 50).alias("part_id"), F.when(k % 3 == 0, k % 60).alias("parent_id"), F.when(k % 2 == 0, k % 8).alias("group_id"))
    return evaluation.identity_audit(p, s.select(c, (k % 6).alias("group_id"), (k % 55).alias("member_id")))


@named("""SELECT path, CASE WHEN b IS NULL THEN 'only_first' WHEN a IS NULL THEN 'only_second' ELSE 'differs' END AS state FROM (SELECT 'f' || p_partkey path, sha256(p_name) a FROM part WHERE p_partkey % 10 <> 0) x FULL JOIN (SELECT 'f' || p_partkey path, sha256(CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END) b FROM part WHERE p_partkey % 11 <> 0) y USING (path) WHERE a IS DISTINCT FROM b""")
def determinism_audit(spark, d):
    """EV19: files that two runs don't have alike."""
    p, path = table(spark, d, "part"), F.concat(F.lit("f"), F.col("p_partkey")).alias("path")
    b = F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    return validation.differing_runs(p.where("p_partkey % 10 <> 0").select(path, F.sha2("p_name", 256).alias("sha256")), p.where("p_partkey % 11 <> 0").select(path, F.sha2(b, 256).alias("sha256")))


@named()
def semantic_thresholds(spark, d):
    """EV1: precision, recall and F1 at eleven thresholds, under names."""
    x = table(spark, d, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("case_id"), F.col("l_suppkey").alias("set_id"), F.concat(F.lit("n"), F.col("l_suppkey") % 4).alias("name"), F.col("l_partkey").alias("e"), (F.month("l_shipdate") <= 6).alias("first")).distinct()
    return assignment.semantic_threshold_scores(x.where("NOT first").drop("first"), x.where("first").drop("first"))


@named()
def package_layers(spark, d):
    """EV3: the fine and the group layer of a package against the truth."""
    x = table(spark, d, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("case_id"), F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("e"), (F.month("l_shipdate") <= 6).alias("first")).distinct()
    p = x.where("NOT first").drop("first")
    return assignment.layer_scores(x.where("first").drop("first"), {"parts": p, "groups": p.withColumn("set_id", F.floor(F.col("set_id") / 2)).distinct()})


@named("""WITH o AS (SELECT l_suppkey % 10 c, l_suppkey s, 200 ar, l_partkey k, 'f' || l_partkey % 3 f, 'n' || l_partkey % 5 n, l_partkey % 9 = 0 se, sum(l_quantity) i FROM lineitem GROUP BY 1, 2, 4) SELECT c AS case_id, s AS component, coalesce(bool_or(i / ar >= 0.35 AND se), false) OR count(DISTINCT CASE WHEN i / ar >= 0.35 THEN f END) >= 2 AS supported FROM o GROUP BY 1, 2""")
def component_support(spark, d):
    """AG12: components that two families or a name support."""
    k = F.col("l_partkey")
    x = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("case_id"), F.col("l_suppkey").alias("component"), k).agg(F.sum("l_quantity").alias("inter"))
    x = x.withColumns({"area": F.lit(200), "set_id": k, "family": F.concat(F.lit("f"), k % 3), "name": F.concat(F.lit("n"), k % 5), "semantic": k % 9 == 0})
    return evaluation.component_support(x).select("case_id", "component", "supported")


@named(f"""WITH {hy._E}, {hy._C}, u AS (SELECT s // {hy.CASE} q, s % 5 k, count(DISTINCT e) a FROM e GROUP BY 1, 2), g AS (SELECT s // {hy.CASE} q, s % 5 k, count(*) m, max(score) c FROM c GROUP BY 1, 2), x AS (SELECT q, k, m, a, 3 * m + c + 2 * sqrt(a / 3000) v FROM g JOIN u USING (q, k)) SELECT q AS case_id, k AS cluster, m AS members, a AS area, round(v, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY v DESC, k) = 1 AS selected FROM x""")
def consensus_seed(spark, d):
    """AG26: the cluster that most routes confirm."""
    c = hy.candidates(spark, d)
    x = evaluation.consensus_seed(c.select("case_id", "set_id", F.col("score").alias("confidence")), c.select("case_id", "set_id", (F.col("set_id") % 5).alias("cluster")), hy.elements(spark, d), c.select("case_id").distinct().withColumn("area", F.lit(3000)))
    return x.select("case_id", "cluster", "members", "area", r6(F.col("score")).alias("score"), "selected")


# -- validation --

_REC = "r AS (SELECT s_nationkey % 4 c, s_suppkey id, s_suppkey % 6 a, CASE WHEN s_suppkey % 5 = 0 THEN 'x_region' WHEN s_suppkey % 7 = 0 THEN 'visual_x' ELSE 'n' || s_suppkey % 3 END n, 'n' || s_suppkey % 4 p, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey // 2 + s_suppkey % 2 * 500000 END pr, s_suppkey * 37 % 400 ar FROM supplier)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 4).alias("case_id"), k.alias("part_id"), (k % 6).alias("asset_id"), F.when(k % 5 == 0, "x_region").when(k % 7 == 0, "visual_x").otherwise(F.concat(F.lit("n"), k % 3)).alias("name"), F.concat(F.lit("n"), k % 4).alias("parent"),
        F.when(k % 3 == 0, F.floor(k / 2) + k % 2 * 500000).alias("parent_id"), (k * 37 % 400).alias("area"),
    )


_PST = f"""{_REC}, fp AS (SELECT r.c, r.id, CASE WHEN q.id IS NULL THEN 'unresolved_parent' WHEN q.a <> r.a THEN 'parent_of_another_asset' END e FROM r LEFT JOIN r q ON q.c = r.c AND q.id = r.pr WHERE r.pr IS NOT NULL),
ac AS (SELECT c, count(*) k, avg((n = 1)::INT) s, max(n) m FROM (SELECT c, a, count(*) n FROM r GROUP BY 1, 2) GROUP BY 1), ps AS (SELECT r.c, count(*) parts, count(*) FILTER (n = p) roots, avg((n = 'x_region' OR n = 'visual_x')::INT) gs, avg((ar <= 60)::INT) ts, sum(CASE WHEN n = 'x_region' OR n = 'visual_x' THEN ar ELSE 0 END) / greatest(sum(ar), 1) ga, sum(CASE WHEN n = p THEN ar ELSE 0 END) / greatest(sum(ar), 1) ra FROM r GROUP BY 1),
st AS (SELECT ps.*, k assets, s ss, m / parts dm, (SELECT count(*) FROM fp WHERE fp.c = ps.c AND e = 'unresolved_parent') mp, (SELECT count(*) FROM fp WHERE fp.c = ps.c AND e = 'parent_of_another_asset') xp FROM ps JOIN ac USING (c))"""


@named(f"WITH {_PST} SELECT c AS case_id, parts, roots, round(gs, 6) AS generic_share, round(ts, 6) AS tiny_share, round(ga, 6) AS generic_area_share, round(ra, 6) AS root_area_share, assets, round(ss, 6) AS singleton_share, round(dm, 6) AS dominant_share, mp AS missing_parents, xp AS foreign_parents FROM st")
def part_structure(spark, d):
    """AG14, VL4: counts and shares of a package's parts."""
    x = validation.part_structure(_records(spark, d), F.lit(500000))
    return x.select("case_id", "parts", "roots", "assets", "missing_parents", "foreign_parents", *(r6(F.col(k)).alias(k) for k in ("generic_share", "tiny_share", "generic_area_share", "root_area_share", "singleton_share", "dominant_share")))


@named(f"WITH {_REC} SELECT c AS case_id, a AS asset_id, n AS name, count(*) AS instances, min(ar) AS smallest, max(ar) AS largest FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND min(ar) <= 60 AND max(ar) >= 240 AND min(ar) / greatest(max(ar), 1) < 0.08")
def imbalances(spark, d):
    """AG13: repeated parts of very unlike size."""
    return validation.imbalances(_records(spark, d), F.lit(500000))


@named(f"""WITH {_PST}, z AS (SELECT *, list_filter([CASE WHEN gs > 0.45 THEN 'many_generic_parts' END, CASE WHEN ts > 0.35 THEN 'many_tiny_parts' END, CASE WHEN ra > 0.65 THEN 'dominant_root_residual' END, CASE WHEN parts > 20 THEN 'unusually_many_scene_parts' END, CASE WHEN assets >= 4 AND ss > 0.6 THEN 'many_singleton_scene_assets' END, CASE WHEN assets >= 4 AND dm > 0.7 THEN 'scene_asset_ownership_imbalance' END], lambda x: x IS NOT NULL) w FROM st)
SELECT c AS case_id, array_to_string(w, ',') AS reasons, CASE WHEN mp + xp > 0 AND c <> 1 THEN 'invalid_hierarchy' WHEN c = 2 THEN 'target_selection_required' WHEN parts = 0 THEN 'no_parts_found' WHEN len(w) > 0 THEN 'review_recommended' ELSE 'ready' END AS status FROM z""".replace(" AND c <> 1", ""))
def package_status(spark, d):
    """VL8: reasons and status of a package."""
    x = validation.package_status(validation.part_structure(_records(spark, d), F.lit(500000)), F.col("case_id") == 2, many=20)
    return x.select("case_id", F.array_join("reasons", ",").alias("reasons"), "status")


@named("""WITH g AS (SELECT o_custkey c, o_orderkey k, o_orderpriority n, o_totalprice / 512347 s FROM orders), r AS (SELECT *, row_number() OVER w i, lead(s) OVER w s2, lead(n) OVER w n2 FROM g WINDOW w AS (PARTITION BY c ORDER BY s DESC, k)) SELECT c AS case_id, coalesce(s2 >= 0.55 AND (s - s2 <= 0.03 OR (n <> n2 AND s - s2 <= 0.16)), false) AS ambiguous, round(s - s2, 6) AS margin FROM r WHERE i = 1""")
def target_ambiguity(spark, d):
    """VL8: targets that a close second leaves open."""
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("group"), F.col("o_orderpriority").alias("name"), (F.col("o_totalprice") / 512347).alias("score"))
    return validation.target_ambiguous(g).withColumn("margin", r6(F.col("margin")))


@named("""WITH f AS (SELECT DISTINCT o_custkey p, (['parts.json', 'source.png', 'taxonomy.json', 'other'])[o_orderkey % 4 + 1] n FROM orders) SELECT p AS package, r AS path FROM (SELECT DISTINCT p FROM f), (VALUES ('parts.json'), ('source.png'), ('taxonomy.json')) v(r) WHERE (p, r) NOT IN (SELECT (p, n) FROM f)""")
def missing_files(spark, d):
    """VL1: required files that a package lacks."""
    name = F.element_at(F.array(*map(F.lit, ("parts.json", "source.png", "taxonomy.json", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return validation.missing_files(table(spark, d, "orders").select(F.col("o_custkey").alias("package"), name.alias("path")), ["parts.json", "source.png", "taxonomy.json"])


@named("""WITH m AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN '' WHEN p_partkey % 41 = 0 THEN '../f' || p_partkey WHEN p_partkey % 43 = 0 THEN 'f1' ELSE 'f' || p_partkey END path, p_size b, CASE WHEN p_partkey % 47 = 0 THEN 'short' ELSE sha256(p_name) END s FROM part WHERE p_partkey % 53 <> 0), g AS (SELECT path, count(*) n, any_value(b) b, any_value(s) s FROM m GROUP BY 1), f AS (SELECT 'f' || p_partkey path, p_size + (p_partkey % 59 = 0)::INT b, sha256(CASE WHEN p_partkey % 61 = 0 THEN 'x' ELSE p_name END) s FROM part WHERE p_partkey % 67 <> 0),
e AS (SELECT path, CASE WHEN n IS NOT NULL AND path = '' THEN 'malformed_path' WHEN n IS NOT NULL AND path LIKE '../%' THEN 'escaping_path' WHEN n > 1 THEN 'duplicate_path' WHEN n IS NULL THEN 'unlisted_file' WHEN f.b IS NULL THEN 'missing_file' WHEN length(g.s) <> 64 THEN 'malformed_sha256' WHEN g.b <> f.b THEN 'byte_count' WHEN g.s <> f.s THEN 'sha256' END er FROM g FULL JOIN f USING (path)) SELECT path, er AS error FROM e WHERE er IS NOT NULL""")
def manifest_errors(spark, d):
    """VL2: a manifest against the files that are there."""
    k, n = F.col("p_partkey"), F.col("p_name")
    own = F.concat(F.lit("f"), k)
    p = table(spark, d, "part")
    m = p.where(k % 53 != 0).select(F.when(k % 40 == 0, "").when(k % 41 == 0, F.concat(F.lit("../"), own)).when(k % 43 == 0, "f1").otherwise(own).alias("path"), F.col("p_size").alias("bytes"), F.when(k % 47 == 0, "short").otherwise(F.sha2(n, 256)).alias("sha256"))
    f = p.where(k % 67 != 0).select(own.alias("path"), (F.col("p_size") + (k % 59 == 0).cast("int")).alias("bytes"), F.sha2(F.when(k % 61 == 0, "x").otherwise(n), 256).alias("sha256"))
    return validation.manifest_errors(m, f)


@named("""WITH r AS (SELECT DISTINCT l_suppkey % 5 c, l_returnflag i, l_partkey e FROM lineitem WHERE l_quantity > 5), o AS (SELECT DISTINCT l_suppkey % 5 c, l_returnflag i, l_partkey e FROM lineitem WHERE l_quantity < 45) SELECT c AS case_id, i AS "index", count(*) FILTER (o.e IS NULL) AS missing, count(*) FILTER (r.e IS NULL) AS extra FROM r FULL JOIN o USING (c, i, e) GROUP BY 1, 2 HAVING count(*) FILTER (o.e IS NULL) + count(*) FILTER (r.e IS NULL) > 0""".replace("o.e IS NULL", "o.q IS NULL").replace("r.e IS NULL", "r.q IS NULL").replace("l_partkey e FROM", "l_partkey e, 1 q FROM"))
def map_disagreements(spark, d):
    """VL5: records against the map."""
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("case_id"), F.col("l_returnflag").alias("index"), F.col("l_partkey").alias("e"), "l_quantity")
    return validation.map_disagreements(x.where("l_quantity > 5"), x.where("l_quantity < 45"))


@named("""WITH v AS (SELECT DISTINCT l_suppkey k, l_partkey e FROM lineitem WHERE l_discount < 0.08), f AS (SELECT DISTINCT l_suppkey k, l_partkey e FROM lineitem WHERE l_quantity > 3) SELECT k AS part, count(*) AS lost FROM v WHERE (k, e) NOT IN (SELECT (k, e) FROM f) GROUP BY 1""")
def lost_elements(spark, d):
    """VL6: completed sets must hold the visible ones."""
    x = table(spark, d, "lineitem").select(F.lit(0).alias("case_id"), F.col("l_suppkey").alias("part"), F.col("l_partkey").alias("e"), "l_discount", "l_quantity")
    return validation.lost_elements(x.where("l_discount < 0.08"), x.where("l_quantity > 3"), "part").select("part", "lost")


@named("""WITH v AS (SELECT DISTINCT l_suppkey k, l_partkey e FROM lineitem WHERE l_discount < 0.02) SELECT k AS part, count(*) FILTER (e % 100 = 0 OR p_size IS NULL) AS drifted FROM v LEFT JOIN part ON p_partkey = e GROUP BY 1 HAVING count(*) FILTER (e % 100 = 0 OR p_size IS NULL) > 0""")
def visible_drift(spark, d):
    """VL6: visible pixels keep their values."""
    p = table(spark, d, "part")
    s = p.select(F.lit(0).alias("case_id"), F.col("p_partkey").alias("e"), F.col("p_size").alias("v"))
    v = table(spark, d, "lineitem").where("l_discount < 0.02").select(F.lit(0).alias("case_id"), F.col("l_suppkey").alias("part"), F.col("l_partkey").alias("e")).distinct()
    done = v.join(s, ["case_id", "e"]).withColumn("v", F.col("v") + F.when(F.col("e") % 100 == 0, 1).otherwise(0))
    return validation.drifted(s, done, v, "part").select("part", "drifted")


@named("""WITH m AS (SELECT c_custkey c, c_custkey % 20 n FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_custkey c, count(*) n FROM orders GROUP BY 1) SELECT coalesce(m.c, r.c) AS case_id, m.n AS declared, coalesce(r.n, 0) AS found FROM m FULL JOIN r ON m.c = r.c WHERE m.n IS DISTINCT FROM coalesce(r.n, 0)""")
def count_mismatches(spark, d):
    """VL7: numbers of rows against the manifest."""
    m = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 20).alias("declared"))
    return validation.count_mismatches(m, table(spark, d, "orders").select(F.col("o_custkey").alias("case_id")))


@named("SELECT count(*) AS n FROM supplier")
def plugin_rows(spark, d):
    """VL9, UD1: rows of a proposal source that keeps the rules."""
    s = table(spark, d, "supplier")
    return validation.plugin_rows(s, F.lit(False), F.lit(10), F.lit(10), F.col("s_name")).agg(F.count_if(F.col("s_suppkey") >= 0).alias("n"))


# -- sources and sets --


@named("""SELECT count(*) AS n, count(DISTINCT model) AS models, count(b) AS with_b FROM (SELECT s_suppkey k, 'm1' model, NULL b FROM supplier UNION ALL SELECT s_suppkey, 'm2', 1 FROM supplier WHERE s_suppkey % 2 = 0)""")
def ensemble_union(spark, d):
    """SO6, SO7: runs of several models, each row with its model, none merged."""
    s = table(spark, d, "supplier").select("s_suppkey")
    x = ownership.ensemble({"m1": s, "m2": s.where("s_suppkey % 2 = 0").withColumn("b", F.lit(1))})
    return x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models"), F.count("b").alias("with_b"))


@named("""WITH a AS (SELECT 'd' || s_nationkey k, list('p' || s_suppkey % 4 ORDER BY s_suppkey) l FROM supplier GROUP BY 1), b AS (SELECT 'd' || s_nationkey k, list('p' || s_suppkey % 6 ORDER BY s_suppkey) l FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1), u AS (SELECT a.k, list_concat(a.l, coalesce(b.l, [])) l FROM a LEFT JOIN b ON b.k = a.k)
SELECT k AS domain, array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(l, s.x) = s.i), lambda s: s.x), ',') AS prompts FROM u""")
def merged_lists(spark, d):
    """SC11, SO5: lists of an extension follow the base's, in order and without repeats."""
    s = table(spark, d, "supplier")

    def lists(rows: DataFrame, of: int) -> DataFrame:
        one = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("p"), F.col("s_suppkey") % of).alias("p")))), lambda x: x["p"])
        return rows.groupBy(F.concat(F.lit("d"), F.col("s_nationkey")).alias("domain")).agg(one.alias("prompts"))

    m = readers.merge_lists(lists(s, 4), lists(s.where("s_nationkey % 2 = 0"), 6), "domain", ["prompts"])
    return m.select("domain", F.array_join("prompts", ",").alias("prompts"))


@named("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, p_name AS name FROM part""")
def json_safe(spark, d):
    """SC16: rows as JSON without numbers that JSON lacks."""
    v = F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    j = writers.json_safe(table(spark, d, "part").select("p_partkey", v.alias("price"), F.col("p_name").alias("name")))
    return j.select(F.from_json("json", "p_partkey long, price double, name string").alias("j")).select("j.*")


@named("""WITH s AS (SELECT l_suppkey // 4 c, l_suppkey % 4 k, l_suppkey p, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END r, round((avg(l_discount) - 0.0495) * 1000, 6)::DOUBLE v FROM lineitem GROUP BY 1, 2, 3, 4),
q AS (SELECT i.r i, j.r j, m.r m, n.r n FROM range(0, 4) i(r), range(0, 4) j(r), range(0, 4) m(r), range(0, 4) n(r) WHERE (i.r = 0 OR i.r NOT IN (j.r, m.r, n.r)) AND (j.r = 0 OR j.r NOT IN (m.r, n.r)) AND (m.r = 0 OR m.r <> n.r)),
t AS (SELECT c.c, q.*, CASE WHEN i = 0 THEN 0 ELSE coalesce(a.v, -1e9) END + CASE WHEN j = 0 THEN 0 ELSE coalesce(b.v, -1e9) END + CASE WHEN m = 0 THEN 0 ELSE coalesce(d.v, -1e9) END + CASE WHEN n = 0 THEN 0 ELSE coalesce(e.v, -1e9) END v
 FROM (SELECT DISTINCT c FROM s) c CROSS JOIN q LEFT JOIN s a ON a.c = c.c AND a.k = 0 AND a.r = i LEFT JOIN s b ON b.c = c.c AND b.k = 1 AND b.r = j LEFT JOIN s d ON d.c = c.c AND d.k = 2 AND d.r = m LEFT JOIN s e ON e.c = c.c AND e.k = 3 AND e.r = n),
x AS (SELECT c, arg_max([i, j, m, n], v) z FROM t GROUP BY 1)
SELECT p.c AS case_id, p.p AS plan, CASE WHEN s.v >= 0.4 THEN (['A', 'N', 'R'])[s.r] END AS region, CASE WHEN s.v >= 0.4 THEN round(s.v, 6) END AS score FROM (SELECT DISTINCT c, k, p FROM s) p JOIN x ON x.c = p.c LEFT JOIN s ON s.c = p.c AND s.k = p.k AND s.r = z[p.k + 1]""")
def unmatched_plans(spark, d):
    """JN17: plans take regions so that scores add up to most; those without a good enough region stay alone."""
    k = F.col("l_suppkey")
    # in decimals, so that the order of the rows doesn't settle means that are ties in the sixth decimal
    mean = F.sum(F.col("l_discount").cast("decimal(18,8)")) * 1000 / F.count("l_discount").cast("decimal(12,0)")
    score = F.round(mean - F.lit(Decimal("49.5")), 6).cast("double")
    x = table(spark, d, "lineitem").groupBy(F.floor(k / 4).alias("case_id"), k.alias("plan"), F.col("l_returnflag").alias("region")).agg(score.alias("score"))
    return assignment.assign_plans(x, x.select("case_id", "plan").distinct(), 0.4).select("case_id", "plan", "region", r6(F.col("score")).alias("score"))
