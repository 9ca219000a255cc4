"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A class is split by its members' next turn; a class that is left with
one member is retired, and its tail is emitted as a chain of single nodes without looking at it again. Classes that
stay shared are refined on, in rounds of 8, 16, ... turns, so the number of rounds grows with the logarithm of the
longest shared prefix. Folding back needs no rounds: every node has a representative, its smallest member, which is a
member of all nodes above, so what a subtree holds is a sum over its top's members.

Turns are compared by a 128-bit hash of role and text; texts aren't shuffled.

Edge cases: turns are ordered by number, null first, and equal numbers by their content's hash; null role or text is
empty; rows of a null conversation id are left out; a conversation without turns ends at the root; repeated rows are
turns of their own; an empty table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, materialize, meet, table

#: Turns of the first round, and of the longest; rounds double.
FIRST_TURNS, MOST_TURNS = 8, 512
#: Turn numbers are ranked in ranges, ids are joined in ranges, and tails are unrolled in steps of so many.
TURN_RANGE, ID_RANGE, STEP = 1_024, 4_096, 4_096


def turn_table(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, key, bytes): each turn's place from 1, hash of role and text, and UTF-8 bytes of its text.

    A conversation of any length is ranked range by range of its turn numbers, so it isn't one task's work.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    x = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), F.octet_length(t).cast("long").alias("bytes")).where("conv IS NOT NULL")
    x = x.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 62))).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = x.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select("conv", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "key"))
    return x.withColumn("place", place).join(parts, ["conv", "part"]).select("conv", (F.col("before") + F.col("place")).cast("long").alias("pos"), "key", "bytes")


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's comma-joined ids, from rows (depth, cls, ids) in order of (depth, cls, range)."""
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, cls, ids in zip(batch["depth"], batch["cls"], batch["ids"]):
            if (depth, bytes(cls)) == node:
                digest.update(b",")
            else:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, bytes(cls)), hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["depth", "cls", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "cls", "ends_sha256"])


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, cls, ends_sha256) of members (depth, cls, conv); ids meet in ranges, and the ranges of a node are streamed."""
    part = F.floor(F.col("conv") / ID_RANGE).alias("part")
    ids = ends.groupBy("depth", "cls", part).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    ids = ids.repartition("depth", "cls").sortWithinPartitions("depth", "cls", "part").select("depth", "cls", "ids")
    return ids.mapInPandas(_joined_ids, "depth long, cls binary, ends_sha256 string")


def _refine(active: DataFrame, turns: DataFrame, start: int, length: int) -> DataFrame:
    """(conv, len, depth, cls, bytes, n_convs, rep, longest) in the shared classes of depths start+1 to start+length."""
    block = turns.where((F.col("pos") > start) & (F.col("pos") <= start + length)).groupBy("conv")
    block = block.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns")).join(active, "conv")
    keys = F.transform("turns", lambda t: F.hex(t["key"]))
    # a class is named by the class at the round's start and the turns since
    name: Column = F.transform("turns", lambda t, i: F.struct(t["pos"].alias("depth"), t["bytes"].alias("bytes"), F.unhex(F.md5(F.concat(F.hex("cls"), F.array_join(F.slice(keys, 1, i + 1), "")).cast("binary"))).alias("cls")))
    paths = materialize(block.select("conv", "len", F.inline(name)), "paths")
    classes = paths.groupBy("depth", "cls").agg(F.count(F.lit(1)).alias("rows"), F.min("conv").alias("rep"), F.max("len").alias("longest")).where("rows > 1")
    classes = materialize(classes, "classes", compact=True)
    return materialize(meet(paths, classes, ["depth", "cls"]).withColumnRenamed("rows", "n_convs"), "shared")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv, pos, key, bytes), a written table whose places are gapless from 1.

    convs: (conv, len), if there are conversations without turns. Per node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A node's turn is the one at place
    ``depth`` of its conv_id (see ``with_turns``).
    """
    spark = turns.sparkSession
    if convs is None:
        convs = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    convs = materialize(convs.select("conv", "len"), "convs")
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep"), F.max("len").alias("longest")).first()
    root = F.unhex(F.lit("00"))
    active = convs.withColumn("cls", root)
    shared = active.select("conv", "len", F.lit(0).cast("long").alias("depth"), "cls", F.lit(0).cast("long").alias("bytes"), F.lit(top["n"]).cast("long").alias("n_convs"), F.lit(top["rep"]).cast("long").alias("rep"), F.lit(top["longest"]).cast("long").alias("longest"))
    start, length = 0, FIRST_TURNS
    while start < (top["longest"] or 0):
        found = _refine(active, turns, start, length)
        if found.isEmpty():
            break
        shared = shared.unionByName(found)
        start += length
        length = min(2 * length, MOST_TURNS)
        active = found.where(F.col("depth") == start).select("conv", "len", "cls")
    # a conversation's path through shared classes; what follows it is its own chain
    path = Window.partitionBy("conv").orderBy("depth")
    whole, above = Window.partitionBy("conv"), path.rowsBetween(Window.unboundedPreceding, -1)
    heads = F.col("conv") == F.col("rep")
    own = F.when(heads, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    last = F.max("depth").over(whole)
    ends = (F.col("len") == F.col("depth")) & (F.col("longest") == F.col("depth")) & heads
    shared = shared.select(
        "conv", "len", "depth", "cls", "rep", last.alias("last"),
        F.lag("rep").over(path).alias("parent"),
        (F.coalesce(F.lead(heads).over(path).cast("long"), F.lit(0)) + ((F.col("depth") == last) & (F.col("len") > last)).cast("long")).alias("child"),
        F.greatest(F.max(ends.cast("long")).over(whole), (F.col("len") > last).cast("long")).alias("leaf"),
        (F.sum(own).over(whole) - F.coalesce(F.sum(own).over(above), F.lit(0))).alias("saved"),
    )
    shared = materialize(shared, "members")
    nodes = shared.groupBy("depth", "cls").agg(F.min("conv").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nothing = hashlib.sha256(b"").hexdigest()
    nodes = nodes.join(_digests(shared.where("len = depth").select("depth", "cls", "conv")), ["depth", "cls"], "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    # a tail's nodes follow from its length
    tails = shared.where((F.col("depth") == F.col("last")) & (F.col("len") > F.col("last"))).select("conv", "len", "last", "rep")
    tails = tails.select("*", F.explode(F.sequence(F.col("last") + 1, F.col("len"), F.lit(STEP).cast("long"))).alias("first"))
    tails = tails.select("*", F.explode(F.sequence("first", F.least(F.col("first") + STEP - 1, "len"))).alias("depth"))
    end = F.col("depth") == F.col("len")
    tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("last") + 1, F.col("rep")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(end, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    return nodes.select(*tails.columns).unionByName(tails)


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the columns that ``turns`` (conv, pos, ...) has of each node's turn; the root has none."""
    return nodes.join(turns.withColumnsRenamed({"conv": "conv_id", "pos": "depth"}), ["conv_id", "depth"], "left")


#: The contract's rebuilding: conversations in groups of FAMILY share a head of fewer than HEADS turns of the group's first.
FAMILY, HEADS = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, key, bytes) and conversations (conv, len), each conversation starting with the first turns of the first of its family."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"))
    first, head = F.col("conv") - F.pmod("conv", F.lit(FAMILY)), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("long")
    base = convs.where(F.pmod("conv", F.lit(FAMILY)) == 0).select(F.col("conv").alias("first"), F.col("rows").alias("has"))
    convs = convs.withColumns({"first": first, "head": head}).join(base, "first", "left")
    convs = convs.withColumn("given", F.least("head", F.coalesce("has", F.lit(0))))
    convs = materialize(convs.select("conv", "rows", "head", "given", (F.col("given") + F.greatest(F.col("rows") - F.col("head"), F.lit(0))).alias("len")), "families", compact=True)
    own = meet(turns, convs, ["conv"]).where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "key", "bytes")
    heads = turns.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS))
    heads = heads.withColumn("conv", F.explode(F.sequence(F.col("conv"), F.col("conv") + FAMILY - 1))).join(convs.select("conv", "head"), "conv").where("pos <= head")
    return own.unionByName(heads.select(*own.columns)), convs.select("conv", "len")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as made:
        turns = materialize(turn_table(table(spark, sf_dir, "conversations")), "turns")
        turns, convs = rebuilt(turns)
        return made.keep(materialize(prefix_trie(materialize(turns, "rebuilt"), convs), "nodes"))


#: CRC-32 by its polynomial, bit by bit; the trie by lists of turn hashes.
SQL = """
WITH steps AS (SELECT 3988292384::UBIGINT AS poly),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n, c - ((c % 5) + 5) % 5 AS base FROM t GROUP BY c),
bits AS (
  SELECT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * strlen(c::VARCHAR)), lambda i: ((ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::UBIGINT)),
    lambda crc, bit: CASE WHEN ((crc & 1::UBIGINT) <> bit) THEN xor(crc >> 1, poly) ELSE crc >> 1 END) AS crc
  FROM ids, steps),
h AS (SELECT c, xor(crc, 4294967295::UBIGINT) % 9 AS h FROM bits),
f AS (SELECT i.c, i.base, h.h::BIGINT AS h, least(h.h::BIGINT, coalesce(b.n, 0)) AS given FROM ids i JOIN h USING (c) LEFT JOIN ids b ON b.c = i.base),
r AS (SELECT f.c, t.pos - f.h + f.given AS pos, r, x FROM f JOIN t USING (c) WHERE t.pos > f.h
      UNION ALL SELECT f.c, t.pos, r, x FROM f JOIN t ON t.c = f.base WHERE t.pos <= f.h),
l AS (SELECT f.c, coalesce(len(g.keys), 0) AS n, coalesce(g.keys, []) AS keys, coalesce(g.sizes, []) AS sizes FROM f LEFT JOIN
      (SELECT c, list(sha256(concat(strlen(r)::VARCHAR, ':', r, x)) ORDER BY pos) AS keys, list(strlen(x) ORDER BY pos) AS sizes FROM r GROUP BY c) g USING (c)),
m AS (SELECT c, n, d, sha256(concat(array_to_string(keys[1:d], ','))) AS k, CASE WHEN d = 0 THEN NULL ELSE sha256(concat(array_to_string(keys[1:d - 1], ','))) END AS pk, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes
      FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM l)),
nodes AS (SELECT d, k, min(pk) AS pk, min(c) AS rep, count(*) AS n_convs, max(bytes) AS bytes, max(n) AS longest,
          sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
sub AS (SELECT a.d, a.k, sum((v.n_convs - 1) * v.bytes) AS saved, sum(CASE WHEN v.longest = v.d THEN 1 ELSE 0 END) AS leaves
        FROM nodes v JOIN m own ON own.c = v.rep JOIN nodes a ON a.d = own.d AND a.k = own.k WHERE own.d <= v.d GROUP BY a.d, a.k)
SELECT nodes.rep::BIGINT AS conv_id, nodes.d::BIGINT AS depth, p.rep::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM nodes LEFT JOIN kids USING (d, k) LEFT JOIN (SELECT d + 1 AS d, k AS pk, rep FROM nodes) p ON p.d = nodes.d AND p.pk = nodes.pk JOIN sub ON sub.d = nodes.d AND sub.k = nodes.k
"""
