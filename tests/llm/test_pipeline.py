"""The pipeline's stages against what they must keep, on a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from loomgrid.llm import near_dup, pii, quality_rules

from .test_corpus_operators import SCHEMA, corpus


def test_stages_in_order(spark, tmp_path):
    rows = corpus(120, seed=9) + [(700, "mail me at a.b@example.com " + " ".join(f"q{k}" for k in range(80)), "en", "src1", None)]
    d = tmp_path / "sf"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(d / "documents.parquet"))
    docs = spark.read.parquet(str(d / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(d))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    want = {r[0] for r in rows if (m := quality_rules.measure_text(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert set(kept[0]) == want and len(kept[1]) < len(kept[0]) and set(kept[2]) == set(kept[1]) and set(kept[3]) <= set(kept[2])
    assert not any(pii.base_spans(r.text)[k] for r in kept[2].values() for k in pii.BASE_KINDS)
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    got = near_dup.classes(spark.createDataFrame([(k, r.text) for k, r in kept[1].items()], "doc_id long, text string"), percent=80)
    assert got.where("id <> component").count() == 0
    packed = corpus_pipeline.run(spark, str(d)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def run_stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_of_an_empty_table(spark, tmp_path):
    out = run_stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert all(x.count() == 0 for x in out.values())
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    clean = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, clean(k), "en", f"src{k % 3}", 1) for k in range(40)]
    # nulls, repeated rows, ties of near-duplicates, and a text of some hundred thousand words
    rows += [(None, clean(90), "en", "src1", None), (91, clean(91), None, None, 1), (91, clean(91), None, None, 1), (92, None, "en", "src1", 1), (93, "", "en", "src1", 1), (94, clean(1), "en", "src2", 1), (95, clean(95, 200_000), "en", "src0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = ["measures", "host_", "quality_rules", "gone", "id", "row", "block", "leaf", "tokens", "h"]
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(extra)))
    out = run_stages(spark, docs, str(tmp_path))
    for name in ("quality rules", "near-duplicates", "personal data", "mixing"):
        assert out[name].columns == docs.columns, name
    ids = {name: sorted((r.doc_id for r in x.select("doc_id").collect()), key=str) for name, x in out.items()}
    assert ids["quality rules"] == sorted([*range(40), None, 91, 91, 94, 95], key=str)
    assert ids["near-duplicates"] == sorted([*range(40), None, 91, 91, 95], key=str) == ids["personal data"]
    assert set(ids["mixing"]) <= set(ids["personal data"]) and set(ids["packing"]) == set(ids["mixing"])
    packed = {}
    for r in out["packing"].select("sequence_id", "length").collect():
        packed[r.sequence_id] = packed.get(r.sequence_id, 0) + r.length
    assert max(packed.values()) <= 4096


def test_stages_chained_without_writing(spark, tmp_path):
    docs, folder = spark.createDataFrame(corpus(60, seed=3), SCHEMA), str(tmp_path)
    written = {name: sorted(r.doc_id for r in x.select("doc_id").collect()) for name, x in run_stages(spark, docs, folder).items()}
    # every result is lazy and stays readable beside others
    chained, results = docs, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        chained = results[name] = stage(spark, chained, folder)
    again = corpus_pipeline.quality(spark, docs, folder)
    for name, x in results.items():
        assert sorted(r.doc_id for r in x.select("doc_id").collect()) == written[name]
    assert sorted(r.doc_id for r in again.select("doc_id").collect()) == written["quality rules"]
    for x in (*results.values(), again):
        corpus_pipeline.release(x)
