"""Licence scan by a positional rare-token index.

The index is a table (word, template, position). A file's licence words are ranked by inverse document frequency over
the whole corpus, and of each key phrase the rarest are indexed. The places of a file's indexed words are looked up:
each posting of a template, moved by its position, says where the template may start, and only starts at which all of
its postings meet are proposals. A proposal is taken if the template's words agree there well enough and its mandatory
key phrase stands whole. Only DataFrame functions are used, and the plan doesn't grow with the number of templates.

Edge cases: null and empty texts have no words and no labels; texts of any length are read whole, and the places of
their licence words are rows that are dealt to all tasks; of words of equal frequency the smaller ones are indexed
(ties); equal rows get equal results; repeated ids are rows like others; an empty table gives an empty result; extra
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are always reported: two or three words, and their label.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

#: Templates: label, words, mandatory key phrase. Fixed values of well-known notices.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited", "all rights reserved"),
)
#: Words of each key phrase that are indexed (the rarest), and the share of a template's words that must agree.
INDEXED, AGREE = 2, 0.6
#: The index is broadcast up to so many postings, and templates up to so many; both are shuffled beyond.
MAX_POSTINGS = 1_000_000


def _key_start(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def parsed(templates=TEMPLATES) -> list[dict]:
    """Templates as words; key and key_end: where the key phrase begins and ends."""
    out = []
    for label, text, phrase in templates:
        words, key = text.split(), phrase.split()
        at = _key_start(words, key)
        out.append({"label": label, "words": words, "key": at, "key_end": at + len(key)})
    return out


def postings(templates: list[dict], idf: dict[str, float]) -> list[list[tuple[str, int]]]:
    """For each template its postings: (word, position) of the rarest words of its key phrase, which any match must hold."""
    out = []
    for x in templates:
        key = range(x["key"], x["key_end"])
        rare = sorted({x["words"][k] for k in key}, key=lambda w: (-idf[w], w))[:INDEXED]
        out.append([(x["words"][k], k) for k in key if x["words"][k] in rare])
    return out


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row: the id, n_words, places (start and label of base phrases) and found (template matches: label, start, share)."""
    spark, known = docs.sparkSession, parsed(templates)
    keys = sorted({w for x in known for w in x["words"][x["key"] : x["key_end"]]} | {w for p, _ in BASE for w in p})
    vocabulary = F.from_json(F.lit(json.dumps(keys)), "array<string>")
    x = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"), F.monotonically_increasing_id().alias("row"))
    x = x.withColumn("present", F.array_intersect("words", vocabulary))
    # words are kept of files that hold all words of some phrase
    phrases = F.from_json(F.lit(json.dumps(sorted({tuple(sorted(set(v["words"][v["key"] : v["key_end"]]))) for v in known} | {tuple(sorted(set(p))) for p, _ in BASE}))), "array<array<string>>")
    anchored = F.exists(phrases, lambda p: F.size(F.array_except(p, F.col("present"))) == 0)
    x = materialize(x.select("row", "id", F.size("words").cast("long").alias("n_words"), "present", F.when((F.size("present") > 0) & anchored, F.col("words")).alias("words")), "words")

    # document frequencies of the vocabulary, over all rows
    n = x.count()
    df = {r["word"]: r["count"] for r in x.select(F.explode("present").alias("word")).groupBy("word").count().collect()}
    found_at = postings(known, {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in keys})
    index = _rows(spark, [{"word": w, "t": t, "at": k} for t, found in enumerate(found_at) for w, k in found], "word:string,t:int,at:int")
    texts = _rows(spark, [{"t": t, "label": v["label"], "template": v["words"], "key": v["key"], "key_words": v["words"][v["key"] : v["key_end"]], "postings": len(found_at[t])} for t, v in enumerate(known)], "t:int,label:string,template:array<string>,key:int,key_words:array<string>,postings:int")

    # places of indexed words, as starts of the templates that hold them
    kept = x.where(F.col("words").isNotNull())
    held = kept.select("row", F.posexplode("words").alias("i", "word"))
    starts = held.join(small(index, MAX_POSTINGS), "word").groupBy("row", "t", (F.col("i") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("met"))
    starts = starts.join(small(texts, MAX_POSTINGS), "t").where(F.col("met") == F.col("postings"))
    w, start, size = F.col("words"), F.col("start"), F.size("template")
    key = start + F.col("key")
    whole = (key >= 0) & (F.slice(w, F.greatest(key, F.lit(0)) + 1, F.size("key_words")) == F.col("key_words"))
    # a template may begin before the file does
    here = F.slice(w, F.greatest(start, F.lit(0)) + 1, F.greatest(size + F.least(start, F.lit(0)), F.lit(0)))
    there = F.slice("template", F.greatest(-start, F.lit(0)) + 1, size)
    agree = F.size(F.filter(F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)) / size
    found = starts.join(kept.select("row", "words"), "row").where(whole).select("row", F.struct("label", "start", agree.alias("share")).alias("f")).where(F.col("f.share") >= AGREE)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("f")).alias("found"))

    at = lambda i: F.get(w, i)
    base_at = lambda i: F.coalesce(*(F.when(F.array(*(at(i + k) for k in range(len(p)))) == F.array(*map(F.lit, p)), F.lit(label)) for p, label in BASE))
    every = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
    places = F.filter(F.transform(F.when(F.array_contains("present", "license"), every), lambda i: F.struct(i.alias("start"), base_at(i).alias("label"))), lambda s: s["label"].isNotNull())
    out = x.select("row", "id", "n_words", F.coalesce(places, F.array().cast("array<struct<start:int,label:string>>")).alias("places")).join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("found", F.array().cast("array<struct<label:string,start:int,share:double>>")).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    start = F.transform("places", lambda p: p["start"])
    label = F.transform("places", lambda p: p["label"])
    own = F.transform("found", lambda p: p["label"])
    line = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("found", lambda p: p["share"]))
    return x.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(start).cast("long").alias("first_word"),
        F.array_max(start).cast("long").alias("last_word"),
        line(label).alias("base_labels"),
        line(F.concat(label, own)).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )
