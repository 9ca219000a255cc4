"""Host-level quality rules: rule failures are pooled by host, host rates are shrunk towards an
empirical beta prior, and the hosts' verdicts are joined back to their documents.

Edge cases: a null or empty text has no words and so fails the base rule; texts of any length are measured whole;
null hosts form one host; a host exactly at the rate stays (ties favour it); repeated rows and ids count each and are
judged alike; an empty table gives an empty result; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, fresh, materialize, small, table

MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
#: Beyond so many words repeats are counted on integer arrays, which need less memory than tuples.
_TUPLE_WORDS = 50_000
#: Parts into which a host's rows fall where hosts are too many to broadcast.
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n <= _TUPLE_WORDS and len(set(zip(words, words[1:], words[2:]))) == n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1].astype(np.int64) * len(ids) + w[2:], return_inverse=True, return_counts=True)
    often = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= often
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes.split() splits on exactly 0x20 and 0x09-0x0D
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(texts: pa.Array) -> pa.Array:
    WordCache.release()
    rows = np.array([measure_text(x.as_py()) for x in texts], np.int64).reshape(-1, 5)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(5)], names=names)


def measure(text: Column) -> Column:
    return F.arrow_udf(_measure, MEASURES)(text)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def rule_failed(m: str, max_symbol_share: float = 0.1, max_dup_lines: int = 30, word_length: tuple[float, float] = (2.0, 15.0)) -> Column:
    """A document fails if it fails the base rule, or has too many symbols, repeated lines or odd word lengths."""
    words = F.col(f"{m}.n_words")
    mean = F.col(f"{m}.word_chars") / F.greatest(words, F.lit(1))
    return (
        base_failed(m)
        | (F.col(f"{m}.n_symbols") > max_symbol_share * words)
        | (F.col(f"{m}.n_dup_lines") > max_dup_lines)
        | ~mean.between(*word_length)
    )


def beta_prior(hosts: int, docs: float, fails: float, docs2: float, fails2_per_doc: float) -> tuple[float, float]:
    """Moment estimate of a beta prior over host failure rates.

    docs, fails: totals over hosts; docs2: sum of squared host sizes; fails2_per_doc: sum of fails^2 / docs.
    """
    if not docs:
        return 1.0, 1.0
    m = min(max(fails / docs, 0.5 / docs), 1 - 0.5 / docs) if docs > 1 else 0.5
    within = m * (1 - m)
    room = docs - docs2 / docs - (hosts - 1)
    between = (fails2_per_doc - m * m * docs - within * (hosts - 1)) / (within * room) if room > 0 else 0.0
    strength = 1 / min(max(between, 1e-3), 0.5) - 1
    return m * strength, (1 - m) * strength


def _bad_hosts(measured: DataFrame, m: str, host_col: str, max_host_rate: float) -> DataFrame:
    """(host, rate) of hosts whose shrunken failure rate is above the limit; partial sums, so a hot host costs one row per task."""
    hosts = materialize(measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(rule_failed(m).cast("long")).alias("fails")), "hosts", compact=True)
    t = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        *(F.coalesce(F.sum(e).cast("double"), F.lit(0.0)).alias(k) for k, e in (("docs", F.col("docs")), ("fails", F.col("fails")), ("docs2", F.col("docs").cast("double") ** 2), ("fails2_per_doc", F.col("fails").cast("double") ** 2 / F.col("docs")))),
    ).first()
    a, b = beta_prior(**t.asDict())
    return hosts.select("host", ((F.col("fails") + a) / (F.col("docs") + a + b)).alias("rate")).where(F.col("rate") > max_host_rate)


def _judged(measured: DataFrame, m: str, bad: DataFrame, host_col: str, broadcast_hosts: int, out: str) -> DataFrame:
    """``measured`` with a struct ``out`` in place of its measures ``m``. More than ``broadcast_hosts`` rejected hosts meet rows by host and salt."""
    h, s, rate_, mine = (fresh(k, measured) for k in ("host_", "salt_", "host_rate_", "salt"))
    bad = bad.select(F.col("host").alias(h), F.col("rate").alias(rate_))
    same = F.col(host_col).eqNullSafe(F.col(h))
    if bad.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        judged = measured.join(F.broadcast(bad), same, "left")
    else:
        salted = bad.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = measured.withColumn(mine, F.pmod(F.xxhash64(m, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(mine) == F.col(s)), "left").drop(mine, s)
    failed = base_failed(m)
    return judged.withColumn(
        out,
        F.struct(f"{m}.*", failed.alias("base_failed"), F.col(rate_).alias("host_rate"), (~failed & F.col(rate_).isNull()).alias("kept")),
    ).drop(m, h, rate_)


def assess(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_host_rate: float = 0.5, broadcast_hosts: int = 50_000, out: str = "quality_rules", texts: bool = True) -> DataFrame:
    """``docs``, without its texts unless ``texts``, with a struct column ``out``: the measures, base_failed, host_rate (of rejected hosts, else null) and kept.

    Texts are read and measured once; the measured rows are written, and the pooling by host and the verdicts start from there.
    """
    m = fresh("measures", docs)
    measured = docs.withColumn(m, measure(F.col(text_col)))
    measured = materialize(measured if texts else measured.drop(text_col), "measured")
    return _judged(measured, m, _bad_hosts(measured, m, host_col, max_host_rate), host_col, broadcast_hosts, out)


def keep_clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_host_rate: float = 0.5, broadcast_hosts: int = 50_000, broadcast_keys: int = 2_000_000) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    A verdict follows from text and host, so rejected ones are told by 128 bits of these, and no copy of the texts is written.
    """
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.col(host_col)
    keys = [F.xxhash64(F.lit(seed), text, host.isNull(), F.coalesce(host.cast("string"), F.lit(""))) for seed in (1, 2)]
    measured = materialize(docs.select(host.alias("host"), *(k.alias(n) for k, n in zip(keys, ("k1", "k2"))), measure(F.col(text_col)).alias("m")), "measured")
    judged = _judged(measured, "m", _bad_hosts(measured, "m", "host", max_host_rate), "host", broadcast_hosts, "verdict")
    one, two = fresh("key_one", docs), fresh("key_two", docs)
    gone = materialize(judged.where(~F.col("verdict.kept")).select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct(), "rejected", compact=True)
    return docs.join(small(gone, broadcast_keys), (keys[0] == F.col(one)) & (keys[1] == F.col(two)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = assess(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    return judged.select("doc_id", "quality_rules.*")


SQL = r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM t)),
o AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) n FROM g JOIN o USING (doc_id, g), range(0, 3) r(k) GROUP BY 1),
m AS (SELECT t.doc_id, source, len(w) n_words, length(regexp_replace(x, '[\x09-\x0D ]', '', 'g')) word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) n_symbols,
  len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x09-\x0D ]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x09-\x0D ]')))) n_dup_lines, coalesce(c.n, 0) n_repeat_words FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m),
h AS (SELECT source, count(*) d, count(*) FILTER (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 30 OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 15)) f FROM b GROUP BY 1),
s AS (SELECT count(*) h, sum(d) d, sum(f) f, sum(d * d) d2, sum(f * f / d) f2, least(greatest(sum(f) / sum(d), 0.5 / sum(d)), 1 - 0.5 / sum(d)) q FROM h),
v AS (SELECT *, d - d2 / d - (h - 1) room, q * (1 - q) w FROM s),
a AS (SELECT q, 1 / least(greatest(CASE WHEN room > 0 THEN (f2 - q * q * d - w * (h - 1)) / (w * room) ELSE 0 END, 0.001), 0.5) - 1 z FROM v),
e AS (SELECT source, (f + q * z) / (d + z) r FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN r > 0.5 THEN r END AS host_rate, NOT base_failed AND NOT coalesce(r > 0.5, false) AS kept FROM b LEFT JOIN e ON e.source IS NOT DISTINCT FROM b.source"""
