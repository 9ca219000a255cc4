"""A corpus pipeline of five stages: quality rules, near-duplicates, personal data, mixing, packing.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``.

Edge cases, of every stage: an empty table gives an empty result; other columns pass through, whatever they are
called; texts of any length are worked on whole; rows that repeat a document are judged alike, and those that repeat
an id stay or go together. Null and empty texts fail the quality rules. A null id is in no near-duplicate group, so
its row stays, and is packed as any other. A null source is a host of its own, and null sources and languages are
leaves of their own in the mix. Of equal documents the one of smallest id stays.

A stage's result reads tables below the shared folder and is lazy: stages can be chained without writing in between,
and several results used at once. ``run`` deletes a stage's tables once the next one's input is written; whoever
calls stages by themselves may call ``release`` then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import mixing, near_dup, packing, pii, quality_rules
from loomgrid.llm.common import Scratch, delete_table, materialize, table

#: Share of the remaining tokens that the mix may use.
BUDGET_SHARE = 0.9


def _stage(of: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with Scratch(spark, delete=False) as made:
            out = of(spark, docs, sf_dir)
        out._loomgrid_scratch = made
        return out

    return run


def release(result: DataFrame) -> None:
    """Delete the tables that a stage's result reads, once it (and all that was made from it) is written."""
    result._loomgrid_scratch.delete()


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality_rules.keep_clean(docs)


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dup.deduplicate(docs, percent=80)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; n_chars follows."""
    text = materialize(docs.withColumn("text", pii.redact(F.col("text"))), "redacted")
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else text


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that bring domains, languages and sources to their target weights, each at most once."""
    return mixing.select(docs, mixing.corpus_levels(), weights=mixing.WEIGHTS, budget_share=BUDGET_SHARE)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", deduplicate),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Circulant MinHash, the CRF and the genetic algorithm have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        docs = materialize(result, name.replace(" ", "_"))
        release(result)
        if before:
            delete_table(spark, before)
        before = docs._loomgrid_table
    return STAGES[-1][1](spark, docs, sf_dir)
