"""Near-duplicate groups by circulant MinHash.

Two permutations make every signature coordinate: the first scatters a document's shingles over the slots of
a circle, the second ranks the slots; coordinate k is the least rank after the circle is shifted by k. Bands of
coordinates bring documents together, and each candidate pair is confirmed on the full shingle sets.

Texts with equal shingle sets collapse into one class before banding, so copies cost one row each. Within a
bucket pairs are not expanded: members are tested against a centre, those that link become one component, and
only members of different components are tested again. Buckets that still hold many components, such as clouds of
copies with many edits each, are finished exactly by their differences from the centre: two members can only link
if their differences overlap, so an index on each member's rarest difference shingles finds all pairs to test.

Rows of a bucket, class or difference that many documents share meet what is known of it by broadcast, not by shuffle.

Edge cases: null, empty and blank texts have no shingles and stay alone; fewer than five words make one shingle;
texts of any length are read whole; of copies and ties the smallest id stands for its group; rows with one doc_id
count as one document; null ids stay out of links and get a null component; an empty table gives an empty result;
other columns of the input are ignored, whatever they are called (``deduplicate`` passes them through).
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .common import SMALL_CACHE_BYTES, Scratch, WordCache, fresh, materialize, meet, small, table

WORDS = 5
#: 40 bands of 8: a pair at similarity 0.85 shares none with probability 3e-6; at 0.5 it shares one with 0.15.
BANDS, ROWS = 40, 8
SLOTS = 1 << 18
SEED = 20011
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_WORDS = WordCache(lambda w: xxhash.xxh3_64_intdigest(w), SMALL_CACHE_BYTES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a whole text."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    _WORDS.trim()
    n = len(w) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = h + w[k : k + n] * np.uint64(_M[k])
    return np.unique(_mix(h))


@cache
def _ranks() -> np.ndarray:
    """Row s: ranks of the slots s + k, for each coordinate k."""
    rank = np.random.default_rng(SEED).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: BANDS * ROWS - 1]]), BANDS * ROWS)


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of a non-empty set of shingle hashes."""
    slots = np.unique((s * np.uint64(_M[1])) >> np.uint64(64 - 18)).astype(np.int64)
    ranks, least = _ranks(), None
    for at in range(0, len(slots), 1024):
        part = ranks[slots[at : at + 1024]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    x = signature(s).reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_M[0])
    for k in range(ROWS):
        h = _mix(h + x[:, k] * np.uint64(_M[2]))
    return h.view(np.int64)


def _class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _describe(texts: pa.Array) -> pa.Array:
    _WORDS.take()
    n, keys, bands, before = [], [], [], (None, None)
    for t in texts:
        s = shingles(t.as_py())
        n.append(len(s))
        keys.append(_class_key(s) if len(s) else None)
        if len(s) and before[0] != keys[-1]:
            before = keys[-1], band_keys(s)
        bands.append(before[1] if len(s) else np.empty(0, np.int64))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(bands)], names=["n", "key", "bands"])


def describe(text: Column) -> Column:
    return F.arrow_udf(_describe, "struct<n:bigint,key:binary,bands:array<bigint>>")(text)


def _sets(texts: pa.Array) -> pa.Array:
    _WORDS.take()
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


def _compared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of shared shingles, and the shingles that only one of the two sets has."""
    shared, apart = [], []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        d = np.setxor1d(x, y, assume_unique=True)
        shared.append((len(x) + len(y) - len(d)) // 2)
        apart.append(d.view(np.int64))
    return pa.StructArray.from_arrays([pa.array(shared, pa.int64()), _lists(apart)], names=["shared", "apart"])


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    return _compared(a, b).field("shared")


class _Texts:
    """Texts of chosen documents, and confirmed links among them."""

    def __init__(self, docs: DataFrame, percent: int, broadcast_ids: int):
        self.docs, self.percent, self.broadcast_ids = docs, percent, broadcast_ids

    def of(self, ids: DataFrame) -> DataFrame:
        """The rows (id, text) of ``ids``, which stand for one set each; beyond the broadcast bound texts are shuffled."""
        return self.docs.join(small(ids, self.broadcast_ids), "id", "left_semi")

    def sizes_fit(self, x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def compare(self, pairs: DataFrame, apart: bool = False) -> DataFrame:
        """Pairs (a, b), already written, with ``linked`` and, if asked for, the shingles ``apart``."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", compact=True)
        sets = materialize(self.of(ids).select("id", F.arrow_udf(_sets, "binary")("text").alias("s")), "sets")
        x = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        x = x.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        both = F.arrow_udf(_compared, "struct<shared:bigint,apart:array<bigint>>") if apart else F.arrow_udf(_shared, "bigint")
        x = x.withColumn("d", both("sa", "sb"))
        i, n = (F.col("d.shared") if apart else F.col("d")), (F.octet_length("sa") + F.octet_length("sb")) / 8
        return x.select("a", "b", (100 * i >= self.percent * (n - i)).alias("linked"), *[F.col("d.apart")] * apart)


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("comp", F.col("id"))
    return entries.join(labels.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _open(entries: DataFrame) -> DataFrame:
    """Entries of buckets that hold several components, with the bucket's number of rows."""
    b = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("key", "rows")
    return meet(entries.drop("rows"), materialize(b, "buckets", compact=True), ["key"])


def _centres(entries: DataFrame, by_size: bool) -> DataFrame:
    """(key, cid, cn, cc): a bucket's member of least id, or the one that stands in most open buckets."""
    if by_size:
        seats = entries.groupBy("id").agg(F.count(F.lit(1)).alias("seats"))
        entries = entries.join(seats, "id")
        least = F.struct((-F.col("seats")).alias("s"), "id", "n", "comp")
    else:
        least = F.struct("id", "n", "comp")
    c = entries.groupBy("key").agg(F.min(least).alias("c"), F.count(F.lit(1)).alias("rows"))
    return materialize(c.select("key", F.col("c.id").alias("cid"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc"), "rows"), "centres", compact=True)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _star_pairs(entries: DataFrame, texts: _Texts) -> DataFrame:
    """Each member with the centre of its bucket, if they are of different components."""
    x = meet(entries.drop("rows"), _centres(entries, False), ["key"]).where((F.col("comp") != F.col("cc")) & texts.sizes_fit("n", "cn"))
    return x.select(*_pair("id", "cid")).distinct()


def _cross_pairs(entries: DataFrame, texts: _Texts) -> DataFrame:
    """Members of one bucket that are of different components."""
    o = entries.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    x = entries.join(o, "key").where((F.col("comp") < F.col("comp2")) & texts.sizes_fit("n", "n2"))
    return x.select(*_pair("id", "id2")).distinct()


def _difference_pairs(entries: DataFrame, texts: _Texts) -> DataFrame:
    """Members of different components that may link, by their differences from their bucket's centre.

    With D(x) the shingles that x and the centre don't share, a pair differs by |D(x)| + |D(y)| - 2 * overlap and
    may differ by at most T = (nx + ny) * (100 - percent) / (100 + percent). So a member that doesn't link to the
    centre needs an overlap of at least max(1, |D(x)| - T): all but so many minus one of D(x), rarest first, must
    meet D(y). At the first shingle two members share, what is left of both must still reach their overlap.
    """
    x = materialize(meet(entries.drop("rows"), _centres(entries, True), ["key"]).where("id <> cid").select(F.col("cid").alias("a"), F.col("id").alias("b"), "n", "comp", "cc").distinct(), "spokes")
    d = materialize(texts.compare(x.select("a", "b"), apart=True), "differences")
    e = d.join(x, ["a", "b"]).withColumn("stray", F.col("comp") != F.col("cc"))
    linked = e.where("linked AND stray").select(*_pair("a", "b"))
    p = texts.percent
    share = (100 - p) / (100 + p)
    need = F.greatest(F.lit(1), F.ceil(F.size("apart") - F.col("n") * ((1 + 100 / p) * share) - 1e-6))
    e = e.select("a", "b", "n", "comp", "stray", F.size("apart").alias("d"), F.when(F.col("stray"), F.size("apart") - need + 1).otherwise(F.size("apart")).alias("keep"), F.explode("apart").alias("s"))
    e = e.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("a", "s")))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("df", "s"))).where("rank <= keep AND df > 1")
    e = materialize(e.select("a", "b", "n", "comp", "stray", "d", "rank", "s"), "rarest")
    o = e.select("a", "s", *(F.col(k).alias(f"{k}2") for k in ("b", "n", "comp", "stray", "d", "rank")))
    overlap = (F.col("d") + F.col("d2") - (F.col("n") + F.col("n2")) * share) / 2 - 1e-6
    left = 1 + F.least(F.col("d") - F.col("rank"), F.col("d2") - F.col("rank2"))
    m = e.where("stray").join(o, ["a", "s"]).where((F.col("comp") != F.col("comp2")) & (~F.col("stray2") | (F.col("b") < F.col("b2"))) & texts.sizes_fit("n", "n2") & (left >= overlap))
    return m.select(*_pair("b", "b2")).unionByName(linked).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bucket_rows: int = 16, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(id, n_shingles, component) per row of ``docs``; linked: 100 * shared >= percent * union of shingles.

    Members first meet their bucket's centre. Buckets that then hold several components are finished pair by pair
    (different components only) if they have at most ``bucket_rows`` rows, else by differences from a centre.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with Scratch(spark) as made:
        d = materialize(given.select("id", describe(F.col("text")).alias("d")).select("id", "d.n", "d.key", F.when(F.col("id").isNotNull(), F.col("d.bands")).alias("bands")), "described")
        heads = materialize(d.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows")), "heads", compact=True)
        texts = _Texts(given, percent, broadcast_ids)
        links = tested = labels = None

        def link(of) -> None:
            """Test the pairs that ``of()`` names, unless they were tested before, and bring links and labels up to date."""
            nonlocal links, tested, labels
            with Scratch(spark) as here:
                pairs = of()
                pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs", compact=True)
                if pairs.isEmpty():
                    return
                here.keep(pairs)
                tested = tested.unionByName(pairs) if tested is not None else pairs
                new = materialize(texts.compare(pairs).where("linked").select("a", "b"), "links")
                if not new.isEmpty():
                    here.keep(new)
                    links = links.unionByName(new) if links is not None else new
                    labels = here.keep(materialize(connected_components(links), "labels", compact=True))

        entries = heads.select("id", "n", F.explode("bands").alias("key"))
        met = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "met", compact=True)
        entries = materialize(meet(entries, met, ["key"]), "entries", compact=True)
        link(lambda: _star_pairs(_labelled(entries, None), texts))

        def rest() -> DataFrame:
            here = materialize(_open(_labelled(entries, labels)), "open", compact=True)
            pairs, wide = _cross_pairs(here.where(F.col("rows") <= bucket_rows), texts), here.where(F.col("rows") > bucket_rows)
            return pairs if wide.isEmpty() else pairs.unionByName(_difference_pairs(wide, texts)).distinct()

        link(rest)
        heads = heads.select("key", "id", "rows")
        heads = heads.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "rows") if labels is not None else heads.select("key", F.col("id").alias("component"), "rows")
        d = d.select("id", F.col("n").alias("n_shingles"), "key")
        alone = d.where("key IS NULL").withColumn("component", F.col("id"))
        found = meet(d.where("key IS NOT NULL"), materialize(heads, "classes", compact=True), ["key"], "left").drop("rows")
        out = found.unionByName(alone).select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
        return made.keep(materialize(out, "components", compact=True))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` without the members of a group whose id isn't the group's smallest; rows of null id stay."""
    name = fresh("gone", docs)
    with Scratch(docs.sparkSession) as made:
        gone = made.keep(materialize(classes(docs, id_col, text_col, percent).where("id <> component").select(F.col("id").alias(name)).distinct(), "gone", compact=True))
    return docs.join(small(gone, broadcast_ids), F.col(id_col) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"), percent=85)
    return c.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


#: All pairs by brute force, for small tables.
SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, e FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) e FROM t)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT a, a b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""
