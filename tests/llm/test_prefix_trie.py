"""Prefix tries against nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import prefix_trie
from loomgrid.llm.common import materialize


def brute(convs):
    """Nodes of {conv: [(role, text), ...]}, as a dictionary by sequence."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    ends = {n: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))).encode()).hexdigest() for n, m in members.items()}
    return {(min(m), len(n)): (min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], ends[n]) for n, m in members.items()} if convs else {}


def found(nodes):
    rows = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    out = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return convs


def heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for c in range(120):
        if c % 11 == 3:
            continue
        start = rng.choice([None, 0, 5])
        for k in range(rng.randrange(1, 14)):
            turn = None if k == 0 and start is None else k
            out.append((c, turn, rng.choice(["user", None, "a:b"]), rng.choice(["", None, "hi", "ünï 漢字", f"own {c} {k}"]), 7))
    # long copies, which take several rounds, one of them a prefix of the others, and one that forks late
    for c, n in ((500, 40), (501, 40), (505, 40), (510, 33), (777, 45)):
        out += [(c, k, "user", f"turn {k}" if k < 36 or c != 505 else "other", 7) for k in range(n)]
    out += [(c, 0, "system", "the same first turn", 7) for c in range(2000, 2060)]
    return out + [(None, 0, "user", "no conversation", 7), (900, 2_000_000, "user", "far", 7), (900, -5, "user", "before", 7), (901, 3, "u", "same", 7), (901, 3, "u", "same", 7)]


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def test_trie(spark, rows):
    turns = materialize(prefix_trie.turn_table(spark.createDataFrame(rows, SCHEMA).repartition(5)), "t")
    convs = ordered(rows)
    nodes = prefix_trie.prefix_trie(turns)
    assert found(nodes) == brute(convs)
    texts = {(r.conv_id, r.depth): r.bytes for r in prefix_trie.with_turns(nodes, turns).collect()}
    assert all(b == (len(convs[c][d - 1][1].encode()) if d else None) for (c, d), b in texts.items())


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(prefix_trie.query(spark, str(tmp_path))) == brute(heads(ordered(rows)))


def test_sql_agrees(spark, rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    plain = [r for r in rows if r[0] is not None and r[0] != 901]
    spark.createDataFrame(plain, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {(r[0], r[1]): r[2:] for r in c.sql(prefix_trie.SQL).fetchall()} == found(prefix_trie.query(spark, str(tmp_path)))


@pytest.mark.parametrize("convs", [{}, {7: []}, {7: [], 8: [], 3: []}, {7: [("u", "x")]}, {7: [("u", "x")], 9: [("u", "x")], 4: []}, {k: [("u", "x")] * 3 for k in (-12, 5000, 4_000_000_000)}])
def test_small_tries(spark, convs):
    rows = [(c, k, r, x, 0) for c, turns in convs.items() for k, (r, x) in enumerate(turns)]
    turns = materialize(prefix_trie.turn_table(spark.createDataFrame(rows, SCHEMA)), "t")
    sizes = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv long, len long")
    assert found(prefix_trie.prefix_trie(turns, sizes)) == brute(convs)


def test_turns_are_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_RANGE", 10)
    monkeypatch.setattr(prefix_trie, "STEP", 7)
    rows = [(c, k * 3 if k else None, "u", f"{k} {c if k > 20 else 0}", 0) for c in (1, 2) for k in range(60)]
    turns = materialize(prefix_trie.turn_table(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1))), "t")
    assert [r.pos for r in turns.where("conv = 1").orderBy("pos").collect()] == list(range(1, 61))
    assert found(prefix_trie.prefix_trie(turns)) == brute(ordered(rows))
