"""Document fingerprints from improbable features.

A feature is a window of 64 bytes. Its rank is how rare its entropy is among all disjoint windows of the corpus; among
any 64 successive features the rarest, leftmost one gets a vote, and features with at least 16 votes are selected. Where
these are fewer than 32, fewer votes suffice (8, 4, 2, 1), and if none has a vote the first window stands for the text.
Texts of less than 512 bytes, in which few such windows survive an edit, have all their windows of 8 bytes instead,
and from 256 bytes on as well; a text shorter than 8 bytes is a feature by itself. Features are inserted with five
hashes into Bloom filters of 2,048 bits, by kind; a filter that holds 160 features is followed by the next one of the
chain. The likeness of two chains is the mean over their filters, weighted by their bits, of the best overlap with a
filter of the other chain, normalised between a little more than chance and all bits of the fuller filter; of two
fingerprints the greater one of the kinds that both have counts.

Edge cases: a null text is empty, and an empty text's fingerprint is ""; two empty fingerprints are alike (1), one is
unlike any other (0). In ``compare_with_next`` null ids come last, equal ids are ordered by their text's hash, a single
document follows itself, and repeated rows follow each other. Texts of any length are read whole, in blocks; an empty
table gives an empty result; other columns pass through ``fingerprint`` and are ignored by ``compare_with_next``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, materialize, table

WINDOW, VOTERS = 64, 64
#: Votes that select a feature: the first number that enough features have, or the last.
VOTES, ENOUGH = (16, 8, 4, 2, 1), 32
#: Bytes of a short text's windows, below which a text is short, and from which on it has windows of WINDOW bytes too.
SHORT_WINDOW, SHORT, BOTH = 8, 512, 256
FILTER_BITS, FILTER_FEATURES, HASHES = 2_048, 160, 5
#: Entropies are told apart in thousandths of their maximum; windows below the least one are no features.
LEVELS, LEAST = 1_001, 100
#: Overlap counts from so far between chance and all bits.
CUTOFF = 0.1
#: Window starts that are looked at together; few enough for a CPU's cache.
BLOCK = 1 << 16
_ONE = 1 << 20  # a window's sum if its bytes are all alike; fixed point, so that sums don't depend on where a block begins
_TERMS = np.array([0] + [round(c / WINDOW * np.log2(c) / np.log2(WINDOW) * _ONE) for c in range(1, WINDOW + 1)], np.int32)
_STEPS = np.diff(_TERMS, prepend=0).astype(np.int32)
_NO_FEATURE = LEVELS


def _levels(sums: np.ndarray) -> np.ndarray:
    return ((_ONE - sums) * (LEVELS - 1)) >> 20


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each start, 0..LEVELS-1."""
    if len(data) < WINDOW:
        return np.empty(0, np.int32)
    seen, ahead = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)  # of a byte: how many like it in the window it ends, and begins
    for s in range(1, WINDOW):
        same = data[s:] == data[:-s]
        seen[s:] += same
        ahead[:-s] += same
    sums = np.cumsum(_STEPS[seen], dtype=np.int32)  # may wrap around; differences don't mind
    sums[WINDOW:] -= np.cumsum(_STEPS[ahead[:-WINDOW]], dtype=np.int32)
    return _levels(sums[WINDOW - 1 :])


def disjoint_levels(data: np.ndarray) -> np.ndarray:
    """How many disjoint windows have each level."""
    out = np.zeros(LEVELS, np.int64)
    for at in range(0, len(data) - WINDOW + 1, BLOCK):
        part = data[at : at + BLOCK]
        n = len(part) // WINDOW
        keys = part[: n * WINDOW].reshape(n, WINDOW).astype(np.int64) + 256 * np.arange(n)[:, None]
        counts = np.bincount(keys.ravel(), minlength=256 * n).reshape(n, 256)
        out += np.bincount(_levels(_TERMS[counts].sum(axis=1, dtype=np.int32)), minlength=LEVELS)
    return out


def rarity_ranks(counts: list[int]) -> np.ndarray:
    """Rank of each level: rarest first, equal ones by level; levels below LEAST are no features."""
    ranks = np.empty(LEVELS, np.int32)
    ranks[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    ranks[:LEAST] = _NO_FEATURE
    return ranks


def _votes(data: np.ndarray, whose: np.ndarray, first: int, last: int, ranks: np.ndarray) -> np.ndarray:
    """Votes of the features that start at first..last-1; ``whose`` has each byte's document."""
    lo, hi = max(0, first - VOTERS + 1), min(len(data), last + VOTERS + WINDOW - 2)
    level, doc = entropy_levels(data[lo:hi]), whose[lo:hi]
    n = len(level)
    if n < VOTERS:
        return np.zeros(last - first, np.int64)
    rank = np.where(doc[:n] == doc[WINDOW - 1 :], ranks[level], np.int32(_NO_FEATURE))
    least, s = (rank << 20) | np.arange(n, dtype=np.int32), 1
    while s < VOTERS:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    own = doc[: len(least)] == doc[VOTERS + WINDOW - 2 :]
    least = least[own & (least >> 20 < _NO_FEATURE)] & 0xFFFFF
    votes = np.bincount(least, minlength=n)
    out = np.zeros(last - first, np.int64)
    out[: n - (first - lo)] = votes[first - lo : last - lo]
    return out


def selected(features: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Those of a text's features that have enough votes."""
    for v in VOTES:
        found = features[votes >= v]
        if len(found) >= ENOUGH:
            break
    return found


def _hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes, a multiple of 8."""
    x = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(x.shape[1]):
        h = (h ^ x[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, width)


#: A fingerprint's chains of filters, as rows of bytes: of selected windows, and of a short text's.
Print = tuple[np.ndarray, np.ndarray]


def prints(texts: list[bytes], ranks: np.ndarray) -> list[Print]:
    sizes = np.array([len(t) for t in texts], np.int64)
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
    whose = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    votes = np.concatenate([np.empty(0, np.uint8), *(_votes(data, whose, at, min(at + BLOCK, len(data)), ranks).astype(np.uint8) for at in range(0, len(data), BLOCK))])
    starts = np.flatnonzero(votes)
    votes = votes[starts]
    none = np.empty(0, np.uint64)
    hashes = _hashes(_windows(data, WINDOW)[starts]) if len(starts) else none
    found = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
    chosen: list[np.ndarray] = []  # hashes of each text's features, by kind
    for k, text in enumerate(texts):
        own, long, short = data[ends[k] - sizes[k] : ends[k]], none, none
        if len(text) >= BOTH:
            long = selected(hashes[found[k] : found[k + 1]], votes[found[k] : found[k + 1]])
            if not len(long):
                long = _hashes(own[None, :WINDOW])
        if 0 < len(text) < SHORT:
            short = _hashes(_windows(np.pad(own, (0, max(0, SHORT_WINDOW - len(own)))), SHORT_WINDOW))
        chosen += [long, short]
    h, chain = np.concatenate([none, *chosen]), np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
    # a feature that a text repeats is inserted once
    order = np.lexsort((h, chain))
    again = (h[order][1:] == h[order][:-1]) & (chain[order][1:] == chain[order][:-1])
    once = np.sort(order[np.concatenate([[True], ~again])]) if len(order) else order
    h, chain = h[once], chain[once]
    n = np.bincount(chain, minlength=len(chosen))
    filters = -(-n // FILTER_FEATURES)
    upto = np.cumsum(filters)
    which = (upto - filters)[chain] + (np.arange(len(h)) - (np.cumsum(n) - n)[chain]) // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for j in range(HASHES):
        bits[which, ((h >> np.uint64(11 * j)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    chains = np.split(np.packbits(bits, axis=1), upto[:-1]) if texts else []
    return list(zip(chains[::2], chains[1::2]))


def encode(p: Print) -> str:
    return ".".join(c.tobytes().hex() for c in p) if any(map(len, p)) else ""


def decode(fingerprint: str) -> Print:
    return tuple(np.frombuffer(bytes.fromhex(c), np.uint8).reshape(-1, FILTER_BITS // 8) for c in (fingerprint or ".").split("."))


def likeness(a: Print, b: Print) -> float:
    """0 to 1."""
    if not any(map(len, (*a, *b))):
        return 1.0
    return max((chain_likeness(x, y) for x, y in zip(a, b) if len(x) and len(y)), default=0.0)


def chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains of any length; few pairs of filters are held at a time."""
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    n_x, n_y = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    best_x, best_y, step = np.zeros(len(x)), np.zeros(len(y)), max(1, 4_096 // len(y))
    for at in range(0, len(x), step):
        part, n = x[at : at + step], n_x[at : at + step, None]
        both = np.bitwise_count(part[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
        chance, most = n * n_y / FILTER_BITS, np.maximum(n, n_y)
        least = chance + CUTOFF * (most - chance)
        score = np.clip((both - least) / np.maximum(most - least, 1e-9), 0, 1)
        score[both == most] = 1.0
        best_x[at : at + step] = score.max(axis=1)
        best_y = np.maximum(best_y, score.max(axis=0))
    return float((n_x @ best_x + n_y @ best_y) / (n_x.sum() + n_y.sum()))


def _raw(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in texts.to_pylist()]


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``rarity_ranks`` of all disjoint windows of all texts; LEVELS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in _raw(batch.column(0)):
                if len(text) >= WINDOW:
                    total += disjoint_levels(np.frombuffer(text, np.uint8))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["level", "n"])

    with lean_batches(docs.sparkSession):
        rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = [0] * LEVELS
    for r in rows:
        counts[r["level"]] = r["n"]
    return rarity_ranks(counts)


def fingerprint(text: Column, ranks: np.ndarray) -> Column:
    """The fingerprint of a whole text, with ``corpus_ranks``."""
    return F.arrow_udf(lambda texts: pa.array([encode(p) for p in prints(_raw(texts), ranks)], pa.string()), "string")(text)


#: What is written of a document: bytes, which become text in the result.
_FIGURES = {"n_chars": pa.int64(), "sha256": pa.binary(), "own_long": pa.binary(), "own_short": pa.binary(), "new_long": pa.binary(), "new_short": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_KINDS = {pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _figures(texts: list[str], own: list[Print], ranks: np.ndarray) -> list[tuple]:
    """Of each text but the last: its figures against the text after it."""
    changed = [edited(x, y) for x, y in zip(texts, texts[1:])]
    raw = [x.encode() for x in changed]
    return [
        (len(t), hashlib.sha256(r).digest(), *(x.tobytes() for x in (*a, *c)), likeness(a, c), likeness(a, b))
        for t, r, a, b, c in zip(texts, raw, own, own[1:], prints(raw, ranks))
    ]


def compare_with_next(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text with the last third taken from the next document, and likenesses.

    The next document is the one of next smaller id, and the first one's for the last. Documents are dealt into id
    ranges (the texts' only shuffle) and streamed in order; only a range's first and last text are written, for the
    documents at the ranges' ends.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    x = x.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("row")]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    figures = f"id {kind}, " + ", ".join(f"{c} {_KINDS[t]}" for c, t in _FIGURES.items())
    none = [(None,) * len(_FIGURES)]

    def table_of(ids: pa.Array, rows: list[tuple], *edge) -> pa.RecordBatch:
        """Figures of documents; with their range's number, and which end of it they are, where these are given."""
        columns = [ids] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(_FIGURES.values())]
        columns += [pa.array([v] * len(ids), t) for v, t in zip(edge, (pa.int32(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["id", *_FIGURES, *["part", "edge", "text"][: len(edge)]])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            own = prints([t.encode() for t in texts], ranks)
            if waiting:
                yield table_of(waiting[0], _figures([waiting[1], texts[0]], [waiting[2], own[0]], ranks), part, None, None)
            else:
                yield table_of(ids[:1], none, part, "first", texts[0])
            if len(texts) > 1:
                yield table_of(ids[:-1], _figures(texts, own, ranks), part, None, None)
            waiting = (ids[-1:], texts[-1], own[-1])
        if waiting:
            yield table_of(waiting[0], none, part, "last", waiting[1])

    done = materialize(x.mapInArrow(stream, f"{figures}, part int, edge string, text string"), "compared")
    parts = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = done.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # one row a range
    ends = done.where("edge = 'last'").select("id", "text", "part").join(F.broadcast(after), "part").join(first, "next_part").select("id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_figures([a, b], prints([a.encode(), b.encode()], ranks), ranks)[0] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield table_of(batch.column(0), rows)

    whole = done.where("edge IS NULL").drop("part", "edge", "text").unionByName(ends.mapInArrow(close, figures))
    spelt = lambda k: F.when((F.octet_length(f"{k}_long") == 0) & (F.octet_length(f"{k}_short") == 0), "").otherwise(F.concat(F.lower(F.hex(f"{k}_long")), F.lit("."), F.lower(F.hex(f"{k}_short"))))
    return whole.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha256")).alias("edited_sha256"), spelt("own").alias("fingerprint"), spelt("new").alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_with_next(docs, corpus_ranks(docs))
