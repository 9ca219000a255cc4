"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids split the vectors into cells; in its cell a vector is coded by the product quantiser of its
residual. A query scans the codes of its nearest cells with asymmetric distance tables, keeps its best codes over all
of them, and only these rows' vectors are fetched and ranked exactly, in double precision.

Centroids and codebooks are trained on a bounded sample chosen by hash; every vector is indexed. The sample also
fixes how many cells are read: the fewest that reach a stated share of its own neighbours. And it gives each query a
bound: codes farther than that can't be among its best, so cells return few of them. Cells lie in units of bounded
size (small cells together, by their centroids' first principal component; a hot cell in several), so a hot cell is
many tasks.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; fewer candidates than k give all of them; ties go to the smaller id; a repeated id is searched once per
row and reported once, at its nearest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Training sample, rows of a unit, and the share of the sample's neighbours that the cells read must hold.
SAMPLE_ROWS, UNIT_ROWS, REACH = 20_000, 4_096, 0.96
#: Rows reranked exactly for each query: so many, or this many times the root of all rows if that is more.
RERANK, RERANK_ROOT = 200, 2.0
#: Sample rows that are asked for their neighbours to find the number of cells to read.
ASKED = 256
SUBSPACES, CODES = 16, 256


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct.copy()
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if not full.all():
            c[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return c


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([square_distances(x[k : k + 4096], c).argmin(1) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


@dataclass
class Index:
    """centroids: cells x dimensions; books: for each subspace, codes x width."""

    centroids: np.ndarray
    books: list[np.ndarray]

    @staticmethod
    def train(x: np.ndarray, cells: int, seed: int = 3) -> Index:
        rng = np.random.default_rng(seed)
        c = k_means(x, cells, rng)
        residuals = x - c[nearest(x, c)]
        return Index(c, [k_means(r, CODES, rng) for r in np.array_split(residuals, min(SUBSPACES, x.shape[1]), axis=1)])

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = np.array_split(x - self.centroids[cell], len(self.books), axis=1)
        return np.stack([nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def residuals(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)

    def offsets(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What a code adds to a square distance whatever the query: with centroid c and residual r, r.r + 2 c.r."""
        r = self.residuals(codes)
        return (r * r).sum(1) + 2 * (self.centroids[cell] * r).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """-2 q.b for each code b of each subspace. A code's square distance from q is the sum of its entries, its
        offset, and the square distance of q from its cell's centroid, so one set of tables serves all cells."""
        out = np.zeros((len(self.books), CODES))
        for s, (p, b) in enumerate(zip(np.array_split(q, len(self.books)), self.books)):
            out[s, : len(b)] = -2 * (b @ p)
        return out

    def probes(self, x: np.ndarray, k: int, reach: float, seed: int = 4) -> int:
        """The fewest cells that hold a share ``reach`` of the ``k`` nearest of some rows of ``x`` among all of ``x``."""
        asked = np.random.default_rng(seed).permutation(len(x))[:ASKED]
        d = square_distances(x[asked], x)
        d[np.arange(len(asked)), asked] = np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = square_distances(x[asked], self.centroids).argsort(1).argsort(1)
        rank = np.take_along_axis(place, nearest(x, self.centroids)[near], axis=1)
        return int(np.quantile(rank, reach, method="higher")) + 1

    def units(self, sizes: np.ndarray, unit_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its first unit, and in how many units it lies (1 unless it has more than ``unit_rows`` rows)."""
        centred = self.centroids - self.centroids.mean(0)
        along = np.linalg.svd(centred, full_matrices=False)[2][0] @ centred.T
        parts = np.maximum(1, -(-sizes // unit_rows))
        first, unit, held = np.zeros(len(sizes), np.int64), 0, 0
        for c in np.argsort(along, kind="stable").tolist():
            if held and held + sizes[c] > unit_rows:
                unit, held = unit + 1, 0
            first[c] = unit
            held += int(sizes[c])
            if parts[c] > 1:
                unit, held = unit + int(parts[c]), 0
        return first, parts


def _usable(v: Column, width: int) -> Column:
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return v.isNotNull() & (F.size(v) == width) & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def candidates(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """(rows, codes): the usable rows (id, v, q), and for each query the rows (query, id, near) whose codes are its best
    over all cells that it reads, the query's own left out. Nothing if no row is usable."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where("id IS NOT NULL")
    widths = given.where(F.size("v") > 0).groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 1
    rows = materialize(given.where(_usable(F.col("v"), width)), "vectors")
    n = rows.count()
    sample = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(9), "id"), 33) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 31)))
    found = sample.select("id", "v").toArrow().sort_by("id")
    if not found.num_rows:
        found = rows.select("id", "v").limit(1).toArrow()
    if not found.num_rows:
        return None
    x = _vectors(found["v"], width)
    index = Index.train(x, int(max(1, min(4096, 2 * n**0.5, len(x) // 8 or 1))))
    cells = len(index.centroids)
    own = nearest(x, index.centroids)
    decoded = (index.centroids[own] + index.residuals(index.encode(x, own))).astype(np.float32)
    least = index.probes(x, k, REACH)
    rerank = max(RERANK, math.ceil(RERANK_ROOT * n**0.5), k)
    # the rank among the sample that the ``rerank``-th of all rows has, and some standard deviations more
    expected = (rerank + 1) * len(x) / n
    rank = math.ceil(expected + 4 * expected**0.5 + 4)

    def assign(batches):
        for t in batches:
            v = _vectors(pa.chunked_array([t["v"]]), width)
            cell = nearest(v, index.centroids)
            codes = index.encode(v, cell)
            rows_ = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([t["id"], pa.array(cell.astype(np.int32)), rows_, pa.array(index.offsets(codes, cell))], names=["id", "cell", "code", "plus"])

    coded = materialize(rows.select("id", "v").mapInArrow(assign, "id long, cell int, code binary, plus double"), "coded")
    sizes = np.zeros(cells, np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most one row a cell
        sizes[r["cell"]] = r["count"]
    first, parts = index.units(sizes, UNIT_ROWS)

    def route(batches):
        """A query's units, with the cells that it reads there, its distances from their centroids, and its bound."""
        schema = pa.schema([("query", pa.int64()), ("unit", pa.int64()), ("v", pa.binary()), ("cells", pa.binary()), ("far", pa.binary()), ("bound", pa.float64())])
        squares = (decoded * decoded).sum(1)
        for t in batches:
            out = []
            for i, v in zip(t["id"].to_pylist(), _vectors(pa.chunked_array([t["v"]]), width)):
                d = square_distances(v[None], index.centroids)[0]
                order = np.argsort(d, kind="stable")
                need = max(min(least, cells), int(np.searchsorted(np.cumsum(sizes[order]), 2 * k + 2)) + 1)
                near = (v @ v) + squares - 2 * (decoded @ v.astype(np.float32)).astype(float)
                bound = float(np.partition(near, rank - 1)[rank - 1]) if rank <= len(near) else math.inf
                read = np.sort(order[:need])
                of = np.repeat(first[read], parts[read]) + np.concatenate([np.arange(p) for p in parts[read]])
                which = np.repeat(read, parts[read])
                for u in np.unique(of).tolist():
                    c = which[of == u]
                    out.append((i, u, v.tobytes(), c.astype("<i4").tobytes(), d[c].tobytes(), bound))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    at = lambda a: F.element_at(F.lit(a.tolist()), F.col("cell") + 1)
    left = coded.select("id", "cell", "code", "plus", (at(first) + F.pmod(F.xxhash64("id"), at(parts))).alias("unit"))
    right = rows.where("q").select("id", "v").mapInArrow(route, "query long, unit long, v binary, cells binary, far binary, bound double")

    def scan(rows_: pa.Table, asked: pa.Table) -> pa.Table:
        ids, near = [], []
        who = []
        if rows_.num_rows and asked.num_rows:
            id_, cell, plus = rows_["id"].to_numpy(), rows_["cell"].to_numpy(), rows_["plus"].to_numpy()
            codes = np.frombuffer(b"".join(rows_["code"].to_pylist()), np.uint8).reshape(len(id_), -1)
            flat = codes.astype(np.int32) + CODES * np.arange(codes.shape[1], dtype=np.int32)
            far = np.empty(cells)
            for q in asked.to_pylist():
                far[:] = np.inf
                far[np.frombuffer(q["cells"], "<i4")] = np.frombuffer(q["far"])
                base = far[cell] + plus
                mine = np.flatnonzero(base < np.inf)
                d = base[mine] + index.tables(np.frombuffer(q["v"])).ravel()[flat[mine]].sum(1)
                best = (d <= q["bound"]) & (id_[mine] != q["query"])
                ids.append(id_[mine[best]])
                near.append(d[best])
                who.append(np.full(int(best.sum()), q["query"], np.int64))
        join = lambda a, kind: pa.array(np.concatenate([np.empty(0, kind), *a]))
        return pa.table({"query": join(who, np.int64), "id": join(ids, np.int64), "near": join(near, np.float64)})

    hits = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(scan, "query long, id long, near double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("near", "id"))
    best = hits.groupBy("query", "id").agg(F.min("near").alias("near")).withColumn("place", place).where(F.col("place") <= rerank)
    return rows, best.drop("place")


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
    return pa.array(np.sqrt(((x - y).reshape(len(a), -1) ** 2).sum(1)) if len(a) else np.empty(0))


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query, rank, vec_id, score): the ``k`` nearest of all other rows for each row where ``queries`` holds.

    The stated query set meets all rows in units of bounded size. Of the rows only codes are scanned; vectors are
    fetched for each query's best codes alone.
    """
    found = candidates(vectors, queries, id_col, vec_col, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query long, rank int, vec_id long, score double")
    rows, best = found
    asked = rows.where("q").select(F.col("id").alias("query"), F.col("v").alias("qv")).distinct()
    x = materialize(best, "best").join(rows.select("id", "v"), "id").join(asked, "query")
    x = x.withColumn("score", F.arrow_udf(_distances, "double")("v", "qv")).groupBy("query", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return x.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    return search(x, F.pmod(F.col("vec_id"), F.lit(100)) == 0).withColumnRenamed("query", "query_id")
