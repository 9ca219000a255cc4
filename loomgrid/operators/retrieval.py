"""Vector and lexical retrieval with margins and open-set rejection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import phrase_score
from ..functions.vectors import unit


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, prototype): the unit vector of the mean of each label's unit vectors. One partial aggregate per dimension."""
    d = vectors.select(label, F.posexplode(unit(F.col(vector))).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("x"))
    g = d.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("kx"))
    return g.select(label, unit(F.transform("kx", lambda s: s["x"])).alias("prototype"))


def similar(queries: DataFrame, index: DataFrame, k: int, max_index_rows: int = 100_000) -> DataFrame:
    """(query, rank, id, label, similarity): the ``k`` most similar index rows of each query, by cosine.

    queries: (query, v); index: (id, label, v), at most ``max_index_rows`` rows, checked; queries are matched in
    Arrow batches against one matrix, in any number. Ties go to the smaller id.
    """
    rows = index.select("id", "label", "v").limit(max_index_rows + 1).toPandas().sort_values("id")
    if len(rows) > max_index_rows:
        raise ValueError(f"the index has more than {max_index_rows} rows; use an approximate index")
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    m = np.stack(rows["v"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    kinds = dict(index.select("id", "label").dtypes)

    def match(batches):
        for t in batches:
            out = []
            for q, v in zip(t["query"], t["v"]):
                v = np.asarray(v, float)
                s = m @ (v / max(np.linalg.norm(v), 1e-8)) if len(ids) else np.zeros(0)
                for r, i in enumerate(np.lexsort((ids, -s))[:k]):
                    out.append((q, r + 1, ids[i], labels[i], float(s[i])))
            yield pd.DataFrame(out, columns=["query", "rank", "id", "label", "similarity"])

    q = queries.select("query", "v")
    return q.mapInPandas(match, f"query {dict(q.dtypes)['query']}, rank int, id {kinds['id']}, label {kinds['label']}, similarity double")


def label_route(hits: DataFrame, temperature: float = 0.055, min_score: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """(query, label, share, margin, accepted) by softmax-weighted votes of hits (query, label, similarity).

    margin: relative gap of the first two labels. A query whose best similarity or margin is too small is rejected.
    """
    w = F.exp((F.col("similarity") - F.max("similarity").over(Window.partitionBy("query"))) / temperature)
    v = hits.withColumn("w", w).groupBy("query", "label").agg(F.sum("w").alias("w"), F.max("similarity").alias("best"))
    order = Window.partitionBy("query").orderBy(F.desc("w"), "label")
    v = v.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy("query")))
    margin = (F.col("w") - F.coalesce("second", F.lit(0.0))) / F.col("w")
    return v.where("n = 1").select("query", "label", (F.col("w") / F.col("total")).alias("share"), margin.alias("margin"), ((F.col("best") >= min_score) & (margin >= min_margin)).alias("accepted"))


def candidate_set(scores: DataFrame, key: str, score: str, drop: float, limit: int, order: list[Column]) -> DataFrame:
    """Rows within ``drop`` of the best of their key, at most ``limit``."""
    top = F.max(score).over(Window.partitionBy(key))
    x = scores.withColumn("_t", top).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *order)))
    return x.where((F.col(score) >= F.col("_t") - drop) & (F.col("_n") <= limit)).drop("_t", "_n")


def consensus(first: DataFrame, second: DataFrame, penalty: float = 0.02) -> DataFrame:
    """Two rankings (region, label, probability) as one: mean probability less a penalty for each place they differ."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("probability"), "label"))
    a = first.withColumn("ra", rank).withColumnRenamed("probability", "pa")
    b = second.withColumn("rb", rank).withColumnRenamed("probability", "pb")
    score = (F.col("pa") + F.col("pb")) / 2 - penalty * F.abs(F.col("ra") - F.col("rb"))
    x = a.join(b, ["region", "label"]).withColumn("score", score)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "label"))).select("region", "label", "score", "rank")


def lexical(names: DataFrame, phrases: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(name, phrase, label, score): phrases that match normalized names; both sides meet on a shared token."""
    n = names.select("name").distinct().withColumn("t", F.explode(F.array_distinct(F.split("name", " "))))
    p = phrases.select("phrase", "label").distinct().withColumn("t", F.explode(F.array_distinct(F.split("phrase", " "))))
    x = n.join(p, "t").select("name", "phrase", "label").distinct()
    return x.withColumn("score", phrase_score(F.col("name"), F.col("phrase"))).where(F.col("score") >= min_score)


def blended(hits: DataFrame, scores: DataFrame, nearest: int = 3, weight: float = 0.3) -> DataFrame:
    """(query, label, score): label scores (query, label, score) mixed with the mean of the label's ``nearest`` assets among hits
    (query, id, label, similarity); ties between assets go to the larger id."""
    w = Window.partitionBy("query", "label").orderBy(F.desc("similarity"), F.desc("id"))
    near = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= nearest).groupBy("query", "label").agg(F.avg("similarity").alias("_m"))
    return scores.join(near, ["query", "label"]).select("query", "label", ((1 - weight) * F.col("score") + weight * F.col("_m")).alias("score"))


def alternatives(scores: DataFrame) -> DataFrame:
    """(region, label, score, margin, rank) of the compatible labels of rows (region, label, similarity, shape, axis, compatible).

    The score adds shape and axis priors; the margin is against the best other label of all, compatible or not, and 1
    without one.
    """
    w = Window.partitionBy("region").orderBy(F.desc("score"), "label")
    x = scores.withColumn("score", F.col("similarity") + F.coalesce("shape", F.lit(0.0)) + F.coalesce("axis", F.lit(0.0)))
    whole = Window.partitionBy("region")
    x = x.withColumn("_n", F.row_number().over(w))
    best, second = (F.max(F.when(F.col("_n") == k, F.col("score"))).over(whole) for k in (1, 2))
    x = x.withColumn("margin", F.col("score") - F.coalesce(F.when(F.col("_n") == 1, second).otherwise(best), F.col("score") - 1.0)).where("compatible")
    return x.select("region", "label", "score", "margin", F.row_number().over(w).alias("rank"))
