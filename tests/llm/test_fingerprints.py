"""Improbable features against a window-by-window count, and likenesses of edited texts."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from loomgrid.llm import fingerprints as fp


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    rng = random.Random(1)
    return fp.rarity_ranks(sum(fp.disjoint_levels(np.frombuffer(prose(rng, 400).encode(), np.uint8)) for _ in range(20)).tolist())


def level(window: bytes) -> int:
    return ((fp._ONE - sum(int(fp._TERMS[c]) for c in collections.Counter(window).values())) * (fp.LEVELS - 1)) >> 20


def test_levels():
    data = np.frombuffer(prose(random.Random(2), 60).encode() + b"a" * 100 + bytes(range(256)), np.uint8)
    want = [level(data[k : k + 64].tobytes()) for k in range(len(data) - 63)]
    assert fp.entropy_levels(data).tolist() == want
    counts = collections.Counter(want[::64])
    assert fp.disjoint_levels(data).tolist() == [counts[k] for k in range(fp.LEVELS)]
    for k in range(0, len(want), 97):
        h = -sum(c / 64 * math.log2(c / 64) for c in collections.Counter(data[k : k + 64].tolist()).values())
        assert abs(want[k] - 1000 * h / 6) < 1.5


def test_votes_are_those_of_each_window(ranks, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 80).encode(), b"a" * 300, b"abc" * 100, b"", b"x", prose(rng, 15).encode(), b"hello world " * 30]
    data, whose = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want = np.zeros(len(data), int)
    at = 0
    for t in texts:
        rank = [int(ranks[level(t[k : k + 64])]) for k in range(len(t) - 63)]
        for w in range(len(rank) - 63):
            k = min(range(w, w + 64), key=lambda i: (rank[i], i))
            want[at + k] += rank[k] < fp._NO_FEATURE
        at += len(t)
    for size in (200, 10_000):
        got = [fp._votes(data, whose, a, min(a + size, len(data)), ranks) for a in range(0, len(data), size)]
        assert np.concatenate(got).tolist() == want.tolist()


def test_prints_do_not_depend_on_batches(ranks, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, n).encode() for n in (1, 3, 20, 60, 90, 400, 3000)] + [b"", b"aaaa", b"b" * 5000, bytes(range(256)) * 9]
    alone = [fp.prints([t], ranks)[0] for t in texts]
    monkeypatch.setattr(fp, "BLOCK", 1000)
    for a, t, c in zip(fp.prints(texts, ranks), texts, alone):
        assert all(map(np.array_equal, a, c)) and fp.likeness(a, c) == 1.0 and any(map(len, a)) == (len(t) > 0)
        assert all(map(np.array_equal, fp.decode(fp.encode(a)), a)) and fp.encode(fp.decode(fp.encode(a))) == fp.encode(a)
    assert len(alone[6][0]) > 1 and fp.likeness(alone[7], alone[7]) == 1 and fp.likeness(alone[7], alone[6]) == 0 == fp.likeness(alone[5], alone[6])


def test_likeness_of_many_filters(ranks):
    rng = random.Random(5)
    a, b = (np.packbits(np.array([[rng.random() < 0.3 for _ in range(2048)] for _ in range(n)]), axis=1) for n in (3, 5))
    whole = fp.chain_likeness(a, b)
    best = [[0.0] * len(b) for _ in a]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n, m, both = (int(np.unpackbits(v).sum()) for v in (x, y, x & y))
            chance, most = n * m / 2048, max(n, m)
            low = chance + fp.CUTOFF * (most - chance)
            best[i][j] = min(1.0, max(0.0, (both - low) / (most - low)))
    n, m = ([int(np.unpackbits(x).sum()) for x in v] for v in (a, b))
    want = (sum(k * max(r) for k, r in zip(n, best)) + sum(k * max(r[j] for r in best) for j, k in enumerate(m))) / (sum(n) + sum(m))
    assert abs(whole - want) < 1e-12


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k * 3, prose(rng, rng.choice([1, 5, 30, 100, 500, 2000])), 7) for k in range(60)]
    rows += [(200, None, 7), (201, "", 7), (202, rows[3][1], 7), (203, "Ünï 漢字 " * 60, 7), (None, "no id", 7), (300, "tie " * 9, 7), (300, "tied " * 9, 7), (301, "twice " * 50, 7), (301, "twice " * 50, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.query(spark, str(tmp_path)).collect()
    by_tie = {r["text"]: r["h"] for r in spark.sql("SELECT t AS text, xxhash64(t) AS h FROM VALUES ('" + "tie " * 9 + "'), ('" + "tied " * 9 + "') AS v(t)").collect()}
    order = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), by_tie.get(r[1], 0)))
    want = collections.Counter()
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        want[k, len(t), hashlib.sha256(fp.edited(t, after).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    ranks = fp.corpus_ranks(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    prints = {k: {fp.encode(fp.prints([(t or "").encode()], ranks)[0]) for i, t, _ in rows if i == k} for k, *_ in rows}
    for r in got:
        assert r.fingerprint in prints[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == fp.likeness(fp.decode(r.fingerprint), fp.decode(r.edited_fingerprint))
        if r.n_chars > 150 and r.doc_id is not None and r.doc_id < 180:
            assert r.near_edited > 0.15 and r.near_next < 0.1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id = 6")
    assert [r.near_next for r in fp.compare_with_next(docs, ranks).collect()] == [1.0]
    assert fp.compare_with_next(docs.where("false"), ranks).count() == 0
    assert docs.select("*", fp.fingerprint(docs["text"], ranks).alias("f")).first()["f"] in prints[6]
