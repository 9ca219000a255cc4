"""Mixing to target weights by hierarchical budgeting.

Weights run down a tree (domain, language, source). A node that can't spend its share passes the shortage to its
siblings, and only when the whole parent is short does it reach the parent's siblings. Each leaf then takes a
token prefix of seeded epochs: whole passes, then the longest prefix of the next pass's order within the budget.

Edge cases: null or empty texts have no tokens and ride along in the prefix; null levels are nodes of their own;
rows that repeat an id are taken or left together; an empty table gives an empty result; other columns pass
through, whatever they are called; ``take`` is named by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: The tree may have so many leaves; they are planned on the driver and broadcast.
MAX_LEAVES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fill(budget: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Shares of ``budget`` in proportion to ``weights``, none above its cap; what a capped one leaves goes to the others."""
    got, free, left = [0.0] * len(caps), [k for k, w in enumerate(weights) if w > 0], min(float(budget), float(sum(c for c, w in zip(caps, weights) if w > 0)))
    while free and left > 0:
        total = sum(weights[k] for k in free)
        full = [k for k in free if caps[k] <= left * weights[k] / total]
        if not full:
            for k in free:
                got[k] = left * weights[k] / total
            break
        for k in full:
            got[k] = float(caps[k])
        left -= sum(caps[k] for k in full)
        free = [k for k in free if k not in set(full)]
    return got


def leaf_budgets(leaves: Mapping[tuple, int], budget: float, weights: Mapping[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """Whole-token budgets by leaf path. ``weights``: path prefix -> weight among its siblings; 1 if absent."""

    def down(prefix: tuple, own: list[tuple], amount: float) -> dict[tuple, float]:
        depth = len(prefix)
        if len(own[0]) == depth:
            return {own[0]: amount}
        groups: dict[tuple, list[tuple]] = {}
        for leaf in own:
            groups.setdefault(leaf[: depth + 1], []).append(leaf)
        names = sorted(groups, key=repr)
        caps = [sum(leaves[x] for x in groups[n]) * max_epochs for n in names]
        shares = fill(amount, [weights.get(n, 1.0) for n in names], caps)
        return {k: v for n, s in zip(names, shares) for k, v in down(n, groups[n], s).items()}

    return {k: int(v + 1e-6) for k, v in down((), list(leaves), budget).items()} if leaves else {}


def _hash(seed: int, epoch: str, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(epoch), F.col(key))


def _bucket(h: str, buckets: str) -> Column:
    """Number of the equal hash range in which ``h``, read as unsigned, lies."""
    return F.shiftrightunsigned(F.shiftrightunsigned(F.col(h), 32) * F.col(buckets), 32)


def choose(docs: DataFrame, levels: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text", weights: Mapping[tuple, float] | None = None, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 11, bucket_docs: int = 2000, take: str = "take") -> DataFrame:
    """``docs`` with a column ``take``: how many times each document is used (documents that aren't are left out).

    budget_share: of all tokens. The texts are read twice (counts, then choice) and never shuffled; what is
    shuffled are sums by leaf and hash range, and the one hash range per leaf in which its prefix ends.
    """
    names = list(levels)
    leaf = F.struct(*(e.cast("string").alias(n) for n, e in levels.items()))
    t = docs.select(F.col(id_col).alias("id"), leaf.alias("leaf"), words(F.col(text_col)).alias("tokens"))
    t = materialize(t, "tokens")
    rows = t.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    have = {tuple(r["leaf"]): (r["tokens"], r["docs"]) for r in rows}
    budgets = leaf_budgets({k: v[0] for k, v in have.items()}, budget_share * sum(v[0] for v in have.values()), weights or {}, max_epochs)
    plan = []
    for k, b in budgets.items():
        tokens, n = have[k]
        copies = max_epochs if not tokens else min(b // tokens, max_epochs)
        plan.append((*k, int(copies), 0 if copies == max_epochs else b - int(copies) * tokens, max(1, -(-n // bucket_docs))))
    schema = ", ".join(f"`{n}` string" for n in names) + ", copies int, rest long, buckets long"
    plan = docs.sparkSession.createDataFrame(plan, schema).select(F.struct(*(F.col(n) for n in names)).alias("leaf"), "copies", "rest", "buckets")

    t = t.join(F.broadcast(plan.where("rest > 0").withColumnRenamed("leaf", "of")), F.col("leaf").eqNullSafe(F.col("of")))
    t = t.withColumn("h", _hash(seed, "copies", "id")).withColumn("bucket", _bucket("h", "buckets"))
    up = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("leaf", "rest", "bucket").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(up))
    over = F.col("upto") > F.col("rest")
    ends = sums.groupBy("leaf").agg(F.min(F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("before"))
    ends = materialize(ends.select(F.col("leaf").alias("of2"), "edge", "before"), "ends")
    # the hash range in which a prefix ends, one for each leaf, is ordered row by row
    edge = t.join(F.broadcast(ends), F.col("leaf").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("edge")))
    edge = edge.groupBy("leaf", "rest", "before", "h", "id").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    cuts = materialize(edge.withColumn("upto", upto).where("upto <= rest").groupBy("leaf").agg(F.max(F.struct("h", "id")).alias("cut")).withColumnRenamed("leaf", "of3"), "cuts")

    plan = plan.join(ends, plan["leaf"].eqNullSafe(ends["of2"]), "left").join(cuts, plan["leaf"].eqNullSafe(cuts["of3"]), "left")
    leaf_, plan_, hash_ = (fresh(k, docs) for k in ("mix_leaf", "mix_plan", "mix_hash"))
    plan = plan.where("copies > 0 OR rest > 0").select(F.struct("leaf", "copies", "rest", "buckets", "edge", "cut").alias(plan_))
    x = docs.withColumn(leaf_, leaf).join(F.broadcast(plan), F.col(leaf_).eqNullSafe(F.col(f"{plan_}.leaf")))
    x = x.withColumn(hash_, _hash(seed, f"{plan_}.copies", id_col))
    bucket, last = _bucket(hash_, f"{plan_}.buckets"), F.col(f"{plan_}.edge")
    more = (F.col(f"{plan_}.rest") > 0) & (last.isNull() | (bucket < last) | ((bucket == last) & (F.struct(F.col(hash_).alias("h"), F.col(id_col).alias("id")) <= F.col(f"{plan_}.cut"))))
    x = x.withColumn(take, F.col(f"{plan_}.copies") + F.when(more, 1).otherwise(0))
    return x.where(F.col(take) > 0).drop(leaf_, plan_, hash_)


def select(docs: DataFrame, levels: Mapping[str, Column], **options) -> DataFrame:
    """The chosen documents, each once and with its own columns."""
    take = fresh("take", docs)
    return choose(docs, levels, max_epochs=1, take=take, **options).drop(take)


#: Of the synthetic corpus: sources fall into four domains by their number; half of each domain's tokens are to be English.
LANGS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
DOMAINS = {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGS.items()}


def corpus_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return {"domain": F.concat(F.lit("domain"), F.coalesce(number.try_cast("int"), F.lit(0)) % 4), "lang": F.col("lang"), "source": F.col("source")}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = corpus_levels()
    got = choose(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), levels, weights=WEIGHTS)
    return got.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("take") - 1)).alias("epoch"), levels["domain"].alias("domain"), "lang", "source", words(F.col("text")).alias("n_tokens"))
