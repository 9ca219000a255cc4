"""The registered queries themselves: every contract column, on small tables with nulls, empties and repeats."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import alignment, ann, classifier, fingerprints, licenses, mixing, near_dup, packing, pii, quality_rules, sharding, token_counts
from loomgrid.llm.queries import QUERIES

from .test_corpus_operators import SCHEMA, brute_base, brute_measures, corpus, shingles, words_of

EXTRA = [
    (900, "write a.b@example.com or 10.0.0.7, card 4111 1111 1111 1111 call +1 (555) 010-9999 now", "en", "src1", 1),
    (901, "x MIT License and Apache license, GNU General Public License too", "de", "src2", 1),
    (902, "Ünï codé ＴＥＸＴ 漢字 " * 30, "fr", None, 1),
    (903, "long words here " * 4000, "en", "src0", 1),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(70, seed=4) + EXTRA
    # repeated ids and null ids aren't in documents; texts, sources and languages may be null
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 70, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, [float((k * j) % 13) for j in range(1, 9)], 0) for k in range(1, 301)] + [(400, None, 0), (500, [0.0] * 8, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(c, t, "user", f"{c % 3} {t}") for c in range(7) for t in range(c)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, {r[0]: r for r in rows}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def rows_of(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_op1(spark, tables):
    got = rows_of(spark, tables, "op1_subword_quality")
    assert {r.doc_id for r in got} == set(tables[1]) and len(got) == len(tables[1])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op2(spark, tables):
    for r in rows_of(spark, tables, "op2_semi_markov_pii"):
        base = brute_base(tables[1][r.doc_id][1] or "")
        n = collections.Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, a, b) for k, a, b in base} <= {(k, int(a), int(b)) for k, a, b in spans} and r.n_spans == len(spans)


def test_op3(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    places = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows_of(spark, tables, "op3_genetic_packing"):
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for k, row in tables[1].items():
        ids = [*tok.encode(row[1] or "", add_special_tokens=False).ids, 1]
        cut = [ids[j : j + 4096] for j in range(0, len(ids), 4096)]
        assert sorted(pieces[k]) == [(j, 4096 * j, len(c), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in c))) for j, c in enumerate(cut)]
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_op5(spark, tables):
    sets = {k: shingles(r[1]) for k, r in tables[1].items()}
    group = {k: k for k in sets}

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows_of(spark, tables, "op5_circulant_minhash")}
    assert got == {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_op6(spark, tables):
    slots = collections.defaultdict(list)
    for r in rows_of(spark, tables, "op6_hypergeometric_shards"):
        raw = (tables[1][r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r.slot)
    n = [len(slots[k]) for k in range(16)]
    assert sum(n) == len(tables[1]) and max(n) - min(n) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, tables):
    for r in rows_of(spark, tables, "op8_host_quality"):
        m = brute_measures(tables[1][r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_op9(spark, tables):
    for r in rows_of(spark, tables, "op9_license_index"):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), tables[1][r.doc_id][1] or ""))
        found = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        at, base = [k for k, _ in found], sorted({x for _, x in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base))
        labels = r.labels.split(",") if r.labels else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1


def test_op10(spark, tables):
    x = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect() if r.embedding and any(r.embedding)}
    got, hits = collections.defaultdict(list), 0
    for r in rows_of(spark, tables, "op10_ivfpq_neighbours"):
        d = sum((a - b) ** 2 for a, b in zip(x[r.query_id], x[r.vec_id])) ** 0.5
        assert abs(d - r.score) < 1e-9 and r.vec_id != r.query_id
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert set(got) == {100, 200, 300}
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        d = sorted((sum((a - b) ** 2 for a, b in zip(x[q], v)) ** 0.5, k) for k, v in x.items() if k != q)
        hits += len({r[2] for r in rows} & {k for _, k in d[:10]})
    assert hits >= 27


def test_op4_and_op7(spark, tables):
    got = rows_of(spark, tables, "op4_hierarchical_mix")
    words = {k: len(words_of(r[1])) for k, r in tables[1].items()}
    assert all(r.n_tokens == words[r.doc_id] and r.epoch in (0, 1) for r in got) and len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert sum(r.n_tokens for r in got) <= 0.6 * sum(words.values()) + 1
    assert {r.doc_id: r.n_words for r in rows_of(spark, tables, "op7_trie_token_counts")} == words


def test_clashing_columns_and_repeated_rows(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").withColumns({c: F.lit(7) for c in ("measures", "host_", "salt_", "quality_rules", "host_rate_", "gone", "id", "row", "block", "p", "words")})
    twice = docs.unionByName(docs.where("doc_id < 10"))
    kept = quality_rules.keep_clean(twice)
    assert kept.columns == docs.columns
    assert near_dup.deduplicate(twice, percent=80).columns == docs.columns
    assert packing.pack_documents(twice).select("doc_id").distinct().count() == docs.count()
    assert licenses.scan(twice).count() == twice.count()


def test_clashing_columns_of_the_other_operators(spark, tables):
    names = ("shard", "slot", "given", "row", "part", "h", "take", "_take", "mix_leaf", "mix_plan", "mix_hash", "leaf", "tokens", "id", "_id", "_text", "b", "n_a", "links", "score", "rank", "query_id", "cell")
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").withColumns({c: F.lit(7) for c in names})
    twice = docs.unionByName(docs.where("doc_id < 10"))
    n = twice.count()
    sharded = sharding.shard(twice, 4)
    assert sharded.columns == [*docs.columns, "_shard", "_slot"] and sharded.where("shard = 7 AND slot = 7 AND h = 7").count() == n and sharded.select("_shard", "_slot").distinct().count() == n
    mixed = mixing.select(twice, mixing.corpus_levels(), weights=mixing.WEIGHTS)
    assert mixed.columns == docs.columns and 0 < mixed.where("take = 7 AND mix_leaf = 7 AND mix_plan = 7").count() == mixed.count()
    for column in (pii.redact(F.col("text")), token_counts.token_counts(F.col("text")), alignment.align(F.col("text"))):
        assert twice.withColumn("added", column).where("row = 7").count() == n
    model = classifier.fit(twice, spark.read.parquet(f"{tables[0]}/labels.parquet").withColumn("_id", F.lit(7)))
    assert twice.withColumn("added", classifier.score(F.col("text"), model)).where("added BETWEEN 0 AND 1 AND score = 7").count() == n
    ranks = fingerprints.corpus_ranks(twice)
    assert fingerprints.compare_with_next(twice, ranks).count() == n
    vectors = spark.read.parquet(f"{tables[0]}/embeddings.parquet")
    more = vectors.withColumns({c: F.lit(7) for c in ("query_id", "rank", "score", "cell", "codes", "unit")})
    assert ann.search(more, F.col("vec_id") % 100 == 0).count() == ann.search(vectors, F.col("vec_id") % 100 == 0).count() > 0
