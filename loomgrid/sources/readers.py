"""Scans: candidate pools, annotations, CSV with a byte-order mark, hashed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import small

CANDIDATE = (
    "case_id string, candidate_index int, semantic_name string, semantic_parent string, score double, source string, prompt string, "
    "source_reliability double, area_px long, metadata map<string,string>"
)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of candidate rows; rows without a name or with a score that isn't finite raise."""
    rows = spark.read.schema(CANDIDATE).json(path)
    bad = F.col("semantic_name").isNull() | (F.trim("semantic_name") == "") | F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return rows.withColumn("score", F.when(bad, F.raise_error(F.concat(F.lit("bad candidate "), F.coalesce(F.col("candidate_index").cast("string"), F.lit("?"))))).otherwise(F.col("score")))


def annotations(spark: SparkSession, path: str, categories: list[str], min_parts: int, min_side: float, per_category: int) -> DataFrame:
    """Ranked object cases of an annotation file (categories, images, annotations).

    Part annotations (category names with a colon) hang on their object's annotation; objects with enough distinct
    parts and a large enough box are ranked per category by parts, then area, then id.
    """
    doc = spark.read.option("multiLine", True).json(path)
    take = lambda k: doc.select(F.explode(k).alias("x")).select("x.*")
    cat = take("categories").select(F.col("id").alias("category_id"), "name")
    a = take("annotations").join(small(cat, 100_000), "category_id")
    parts = a.where(F.contains("name", F.lit(":"))).groupBy(F.col("obj_ann_id").alias("whole")).agg(F.countDistinct("name").alias("parts"))
    objects = a.where(F.col("name").isin(categories)).join(parts, F.col("id") == F.col("whole")).where((F.col("parts") >= min_parts) & (F.least(F.element_at("bbox", 3), F.element_at("bbox", 4)) >= min_side))
    area = F.element_at("bbox", 3) * F.element_at("bbox", 4)
    w = Window.partitionBy("name").orderBy(F.desc("parts"), F.desc(area), "id")
    return objects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_category).select("name", "rank", "id", "image_id", "parts", "bbox")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is taken off."""
    r = spark.read.option("header", True)
    rows = (r.schema(schema) if schema else r).csv(path)
    return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, paths relative to it."""
    f = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(folder)
    inside = F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "")
    return f.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def previous_package(spark: SparkSession, path: str) -> DataFrame:
    """Part rows of an earlier package; group_id falls back to part_id, asset_id to object_001."""
    x = spark.read.parquet(path)
    for name, default in (("group_id", F.col("part_id")), ("asset_id", F.lit("object_001"))):
        x = x.withColumn(name, F.coalesce(F.col(name), default) if name in x.columns else default)
    return x


def merge_lists(base: DataFrame, extension: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """``base`` with its list columns followed by what ``extension`` (key, lists) adds, in order and without repeats; an unknown key raises."""
    unknown = extension.join(base.select(key), key, "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown {key}: {unknown.first()[key]}")
    add = extension.select(key, *(F.col(c).alias(f"_{c}") for c in lists))
    none = lambda c: F.array().cast(dict(base.dtypes)[c])
    both = {c: F.array_distinct(F.concat(F.coalesce(c, none(c)), F.coalesce(f"_{c}", none(c)))) for c in lists}
    return base.join(add, key, "left").withColumns(both).drop(*(f"_{c}" for c in lists))


def masks(spark: SparkSession, path: str, least: int = 128) -> DataFrame:
    """(path, width, height, e) of image files: pixels whose grey value is at least ``least``."""
    import numpy as np
    import pandas as pd

    x = spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def of(batches):
        for t in batches:
            out = []
            for p, w, h, n, b in zip(t["origin"], t["width"], t["height"], t["nChannels"], t["data"]):
                a = np.frombuffer(b, np.uint8).reshape(h, w, n).astype(float)
                # stored blue, green, red
                grey = a[:, :, 0] if n == 1 else np.rint(0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2])
                out += [(p, w, h, int(e)) for e in np.flatnonzero(grey >= least)]
            yield pd.DataFrame(out, columns=["path", "width", "height", "e"])

    return x.mapInPandas(of, "path string, width int, height int, e long")


def tables(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of one JSON document: each top-level list as rows of its schema, absent lists empty."""
    schema = ", ".join(f"`{name}` array<struct<{of}>>" for name, of in schemas.items())
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {name: doc.select(F.explode(F.col(f"`{name}`")).alias("x")).select("x.*") for name in schemas}


def merge_extension(base: DataFrame, extension: DataFrame, keys: list[str], domain: str) -> DataFrame:
    """Append-only merge: an extension may not repeat a key or name an unknown domain."""
    twice = extension.join(base.select(*keys), keys, "left_semi")
    if not twice.isEmpty():
        raise ValueError(f"already there: {twice.first().asDict()}")
    unknown = extension.join(base.select(domain).distinct(), domain, "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown {domain}: {unknown.first()[domain]}")
    return base.unionByName(extension, allowMissingColumns=True)
