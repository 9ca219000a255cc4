"""Uniform sharding by a hypergeometric communication matrix, with exact shard sizes (law: rows).

Rows fall into bounded logical partitions. How many rows each partition sends to each shard is drawn from the
multivariate hypergeometric law, so the matrix is that of a uniform shuffle and shard sizes are exact. Rows are
permuted inside their partition, dealt out by the matrix, and permuted again inside their shard. Only DataFrame
functions touch rows; the matrix (at most MAX_PARTITIONS x shards numbers) is drawn on the driver.

Edge cases: null and empty texts have size 1 and checksum 0; null and repeated ids are rows like others; an empty
table gives an empty result; other columns pass through, whatever they are called. The same files and seed give the
same shards.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, table

#: A partition, and a hash range inside a shard, aims at so many rows; there are at most MAX_PARTITIONS of either.
PART_ROWS, MAX_PARTITIONS = 2_000, 4_096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` from ``good + bad``, for counts of any size: inversion within 12 deviations."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mean = draws * (good / total)
    reach = 12 * (mean * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5 + 10
    first, last = max(lo, int(mean - reach)), min(hi, int(mean + reach) + 1)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts by partition and shard with the given row and column sums, as a uniform shuffle would have them."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in rows:
        room, line = sum(left), []
        for s, cap in enumerate(left):
            got = hypergeometric(rng, cap, room - cap, n)
            line.append(got)
            n, room = n - got, room - cap
        left = [c - g for c, g in zip(left, line)]
        out.append(line)
    return out


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard(rows: DataFrame, shards: int = 16, seed: int = 23) -> DataFrame:
    """``rows`` with shard (0..shards-1, counts at most one apart) and slot (gapless from 0 in each shard).

    Two shuffles of ``rows``; give it narrow rows. Columns of ``rows`` that are called shard or slot stay as they are,
    and the added ones then have underscores before their names (``common.fresh``).
    """
    spark = rows.sparkSession
    shard_, slot_, given = fresh("shard", rows), fresh("slot", rows), fresh("given", rows)
    x = materialize(rows.select(F.struct("*").alias(given), F.monotonically_increasing_id().alias("row")), "rows").withColumnRenamed(given, "given")
    n = x.count()
    parts = min(MAX_PARTITIONS, max(16, n // PART_ROWS))
    x = x.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in x.groupBy("part").count().collect()}
    names = sorted(counts)
    matrix = communication_matrix([counts[p] for p in names], [n // shards + (s < n % shards) for s in range(shards)], seed)
    plan = _inline(spark, [{"part": p, "upto": np.cumsum(m).tolist()} for p, m in zip(names, matrix)], "part:int,upto:array<bigint>")
    # the first permutation; rank r goes to the first shard whose running count exceeds it
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")) - 1
    x = x.withColumn("rank", rank).join(F.broadcast(plan), "part")
    x = x.withColumn("shard", F.size(F.filter("upto", lambda t: t <= F.col("rank"))).cast("int"))
    # the second one, by hash ranges that tasks can sort on their own
    ranges = min(MAX_PARTITIONS, max(1, n // shards // PART_ROWS))
    x = x.withColumn("h", F.xxhash64(F.lit(seed + 2), "row"))
    x = x.withColumn("range", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(ranges).cast("long"), 32).cast("int"))
    x = materialize(x.select("given", "shard", "row", "h", "range"), "dealt")
    sums = x.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("shard", "range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "row")) - 1
    # at most shards x MAX_PARTITIONS rows are broadcast
    x = x.withColumn("place", place).join(F.broadcast(sums), ["shard", "range"])
    return x.select(*(F.col("given")[c].alias(c) for c in rows.columns), F.col("shard").alias(shard_), (F.col("before") + F.col("place")).alias(slot_))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
