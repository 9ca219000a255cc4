"""Quality classifier: supervised subword embeddings.

A document's features are its words and their character n-grams, hashed into buckets, and two buckets for its
three-word n-grams: those that are new at their place and those that the text has had before. Each bucket has a learned
vector; a document is the average of its features' vectors, and a softmax over two classes reads it. Vectors and
output weights are trained together by numpy stochastic gradient descent on the driver, on a bounded sample of
labelled rows. Scoring reads every whole text once, on the executors: since the output is linear in the average,
each word's share is a pair of numbers that workers remember.

Edge cases: null and empty texts have no features and get the class prior; without any usable label every score
is 0.5; equal texts get equal scores; repeated labels of a document count once (the larger); an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, small, table

BUCKETS, DIM = 1 << 16, 12
NGRAMS = (3, 4)
#: About so many labelled rows are used for training, chosen by hash of their id.
SAMPLE_ROWS = 4_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, its ends marked."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    marked = f"<{word}>"
    if marked.isascii():  # then characters are bytes, and slices need no encoding
        raw, crc = marked.encode(), zlib.crc32
        for n in NGRAMS:
            out += [crc(raw[k : k + n], n) % BUCKETS for k in range(len(raw) - n + 1)]
        return out
    for n in NGRAMS:
        out += [zlib.crc32(marked[k : k + n].encode(), n) % BUCKETS for k in range(len(marked) - n + 1)]
    return out


#: Buckets of new and of repeated three-word n-grams, and how many features each n-gram counts as.
NEW, AGAIN, NGRAM_WEIGHT = BUCKETS, BUCKETS + 1, 8


def repeats(words: list[str]) -> tuple[int, int]:
    """Numbers of new and of repeated three-word n-grams."""
    n = max(0, len(words) - 2)
    new = len(set(zip(words, words[1:], words[2:])))
    return new, n - new


def _bags(texts: pa.Array) -> pa.Array:
    """Distinct buckets and their counts, by document."""
    known = WordCache(lambda w: np.array(features(w), np.int32), size=lambda w, f: len(w) + f.nbytes)
    ids, counts = [], []
    for t in texts:
        words = (t.as_py() or "").split()
        parts = [known[w] for w in words]
        known.trim()
        i, c = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int32), return_counts=True)
        more = np.array(repeats(words)) * NGRAM_WEIGHT
        ids.append(np.concatenate([i, np.array([NEW, AGAIN], np.int32)[more > 0]]))
        counts.append(np.concatenate([c, more[more > 0]]).astype(np.float32))
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["ids", "counts"])


@dataclass
class Model:
    """vectors: (buckets + 2) x DIM; output: 2 x DIM; bias: 2."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def logit(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1, before averaging; the log-odds without features."""
        w = self.output[1] - self.output[0]
        return (self.vectors @ w).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 24_000, rate: float = 0.4, seed: int = 5, batch: int = 8) -> Model:
    """Stochastic gradient descent with a falling rate: ``steps`` documents, the gradients of ``batch`` at a time added up."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM)).astype(np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))
    if not labels:
        return m
    share = np.clip(np.mean(labels), 0.01, 0.99)
    m.bias[:] = np.log([1 - share, share])
    prior = m.bias.copy()
    order = np.concatenate([rng.permutation(len(bags)) for _ in range(-(-steps // len(bags)))])[:steps]
    for step in range(0, steps, batch):
        taken = [k for k in order[step : step + batch] if len(bags[k][0])]
        if not taken:
            continue
        lr = rate * (1 - step / steps)
        sizes = [len(bags[k][0]) for k in taken]
        ids, weights = np.concatenate([bags[k][0] for k in taken]), np.concatenate([bags[k][1] / bags[k][1].sum() for k in taken])
        hidden = np.add.reduceat(weights[:, None] * m.vectors[ids], np.cumsum([0, *sizes[:-1]]))
        z = hidden @ m.output.T + m.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(taken)), [labels[k] for k in taken]] -= 1
        back = np.repeat(p @ m.output, sizes, axis=0)
        m.output -= (lr * p.T @ hidden).astype(np.float32)
        # averaging divides a feature's gradient by the document's length; undone up to a bound, rare features learn
        change = (lr * np.minimum(weights * 30, 1.0))[:, None] * back
        by_id = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[by_id], prepend=-1))
        m.vectors[ids[by_id][first]] -= np.add.reduceat(change[by_id], first).astype(np.float32)
        m.bias -= 0.05 * lr * p.sum(0)
    m.bias[:] = np.where(np.isfinite(m.bias), m.bias, prior)
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``sample_rows`` labelled rows that aren't held out; only these rows' features reach the driver."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = usable.count()
    if n > sample_rows:
        usable = usable.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "_id"), 33) < int(sample_rows / n * (1 << 31)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(small(usable, 2 * sample_rows), "_id")
    rows = rows.select("_id", F.arrow_udf(_bags, "struct<ids:array<int>,counts:array<float>>")("_text").alias("b"), "_label").select("_id", "b.ids", "b.counts", "_label")
    t = rows.toArrow().sort_by("_id")
    bags = [(np.asarray(i.values, np.int64), np.asarray(c.values, np.float32)) for i, c in zip(t["ids"], t["counts"])]
    return train(bags, t["_label"].to_pylist())


def score(text: Column, model: Model) -> Column:
    """Probability of class 1."""
    (logits, bias), memo = model.logit(), []
    logits = logits.tolist()

    def word(w: str) -> complex:
        f = features(w)
        return complex(math.fsum(map(logits.__getitem__, f)), len(f))

    def arrow(texts: pa.Array) -> pa.Array:
        memo[:] = memo or [WordCache(word)]
        known, out = memo[0].take(), []
        for t in texts:
            words = (t.as_py() or "").split()
            new, again = repeats(words)
            total = sum(map(known.__getitem__, words), NGRAM_WEIGHT * complex(new * logits[NEW] + again * logits[AGAIN], new + again))
            known.trim()
            z = bias + (total.real / total.imag if total.imag else 0.0)
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(arrow, "double")(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
