"""Integrity rules and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a partition of keys.
DEALT = 1_000_000


def _parts(rows: DataFrame) -> int:
    """Partitions for keys of ``rows``: no fewer than cores, and DEALT rows each in large tables."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // DEALT)


def duplicate_keys(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, key, rows) of keys that stand more than once or are null."""
    key = F.to_json(F.struct(*keys))
    null = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
    dealt = rows.select(*keys).repartition(_parts(rows), *keys)
    return dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | null).select(F.lit(rule).alias("rule"), key.alias("key"), "rows")


def orphans(rows: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, key, rows) of non-null foreign keys without a parent row."""
    parts = _parts(rows)
    counts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).repartition(parts, "_k").groupBy("_k").agg(F.count(F.lit(1)).alias("rows"))
    lost = counts.join(parent.select(F.col(parent_key).alias("_k")).repartition(parts, "_k").distinct(), "_k", "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col("_k").cast("string").alias("key"), "rows")


def manifest_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, error) of a manifest (path, bytes, sha256) against files (path, bytes, sha256) that are there."""
    m = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.first("bytes").alias("mb"), F.first("sha256").alias("ms"))
    f = files.select("path", F.col("bytes").alias("fb"), F.col("sha256").alias("fs"))
    error = (
        F.when(F.col("times").isNotNull() & (F.col("path").isNull() | (F.col("path") == "")), "malformed_path")
        .when(F.col("times").isNotNull() & (F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")), "escaping_path")
        .when(F.col("times") > 1, "duplicate_path")
        .when(F.col("times").isNull(), "unlisted_file")
        .when(F.col("fb").isNull(), "missing_file")
        .when(F.coalesce(F.length("ms"), F.lit(0)) != 64, "malformed_sha256")
        .when(F.col("mb") != F.col("fb"), "byte_count")
        .when(F.lower("ms") != F.lower("fs"), "sha256")
    )
    return m.join(f, "path", "full").select("path", error.alias("error")).where("error IS NOT NULL")


def differing_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, state) of files (path, sha256) that two runs don't have alike."""
    x = first.select("path", F.col("sha256").alias("a")).join(second.select("path", F.col("sha256").alias("b")), "path", "full")
    state = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.col("a") != F.col("b"), "differs")
    return x.select("path", state.alias("state")).where("state IS NOT NULL")


def ladder(rules: list[tuple[str, Column]], otherwise: str | None) -> Column:
    """The first rule that holds."""
    out = None
    for name, c in rules:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """All rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))


def rule_table(rows: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule) of rules (rule, metric, op, value) that fire on rows; op is one of <=, >=, >, is_true."""
    metrics = [c for c, t in rows.dtypes if c != key and t in ("int", "bigint", "float", "double", "boolean")]
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in metrics))).alias("m")).select(key, "m.*")
    x = long.join(rules, "metric")
    op, v = F.col("op"), F.col("x")
    fires = F.when(op == "<=", v <= F.col("value")).when(op == ">=", v >= F.col("value")).when(op == ">", v > F.col("value")).when(op == "is_true", v == 1)
    return x.where(fires).select(key, "rule")


def missing_files(files: DataFrame, required: list[str]) -> DataFrame:
    """(package, path) of required files that a package (package, path) doesn't have; packages are those with any file."""
    want = files.select("package").distinct().withColumn("path", F.explode(F.array(*map(F.lit, required))))
    return want.join(files.select("package", "path").distinct(), ["package", "path"], "left_anti")


def foreign_assets(records: DataFrame) -> DataFrame:
    """(case_id, part_id, error) of assembly parents that aren't there or belong to another asset; records: (case_id, part_id, asset_id, parent_id)."""
    p = records.select("case_id", F.col("part_id").alias("parent_id"), F.col("asset_id").alias("_a")).distinct()
    x = records.where("parent_id IS NOT NULL").join(p, ["case_id", "parent_id"], "left")
    error = F.when(F.col("_a").isNull(), "unresolved_parent").when(~F.col("_a").eqNullSafe(F.col("asset_id")), "parent_of_another_asset")
    return x.select("case_id", "part_id", error.alias("error")).where("error IS NOT NULL")


def map_disagreements(records: DataFrame, owners: DataFrame) -> DataFrame:
    """(case_id, index, missing, extra): elements of records (case_id, index, e) that the map (case_id, index, e) lacks, and the other way."""
    a, b = (x.select("case_id", "index", "e").distinct().withColumn(n, F.lit(1)) for x, n in ((records, "_r"), (owners, "_m")))
    x = a.join(b, ["case_id", "index", "e"], "full").groupBy("case_id", "index").agg(F.count_if(F.col("_m").isNull()).alias("missing"), F.count_if(F.col("_r").isNull()).alias("extra"))
    return x.where("missing + extra > 0")


def lost_elements(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """(case_id, key, lost): sets (case_id, key, e) with elements that aren't in the set that must hold them."""
    x = inner.select("case_id", key, "e").distinct().join(outer.select("case_id", key, "e").distinct(), ["case_id", key, "e"], "left_anti")
    return x.groupBy("case_id", key).agg(F.count(F.lit(1)).alias("lost"))


def drifted(source: DataFrame, completed: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """(case_id, key, drifted): visible elements (case_id, key, e) whose value differs between source (case_id, e, v) and completed (case_id, key, e, v)."""
    x = visible.join(source.select("case_id", "e", F.col("v").alias("_s")), ["case_id", "e"], "left").join(completed.select("case_id", key, "e", F.col("v").alias("_c")), ["case_id", key, "e"], "left")
    return x.groupBy("case_id", key).agg(F.count_if(~F.col("_s").eqNullSafe(F.col("_c"))).alias("drifted")).where("drifted > 0")


def count_mismatches(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """(case_id, declared, found) of cases whose number of rows isn't the manifest's (case_id, declared)."""
    n = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("found"))
    x = manifest.join(n, "case_id", "full").select("case_id", "declared", F.coalesce("found", F.lit(0)).alias("found"))
    return x.where(~F.col("declared").eqNullSafe(F.col("found")))


def plugin_rows(rows: DataFrame, declared: Column, size: Column, image_size: Column, source: Column) -> DataFrame:
    """``rows`` of a proposal source; rows that don't declare that no ground truth was used, are of another size than
    the image or have no source raise when they are read."""
    why = F.when(~declared.eqNullSafe(F.lit(False)), "ground truth not declared unused").when(~size.eqNullSafe(image_size), "mask of another size").when(F.trim(F.coalesce(source, F.lit(""))) == "", "no source")
    return rows.where(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean")))


def part_structure(records: DataFrame, image_area: Column) -> DataFrame:
    """One row a case of records (case_id, part_id, asset_id, name, parent, parent_id, area): counts and shares of generic,
    tiny and root parts, assets of one part, the largest asset, lost and foreign parents. Fixed values: the limits."""
    generic = F.contains("name", F.lit("visual_")) | F.col("name").rlike("_(region|detail)$")
    tiny = F.greatest(F.lit(20), F.bround(image_area * 0.00012))
    share = lambda c: F.avg(c.cast("double"))
    area = F.greatest(F.sum("area"), F.lit(1))
    g = records.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("name") == F.col("parent")).alias("roots"), share(generic).alias("generic_share"), share(F.col("area") <= tiny).alias("tiny_share"),
        (F.sum(F.when(generic, F.col("area")).otherwise(0)) / area).alias("generic_area_share"), (F.sum(F.when(F.col("name") == F.col("parent"), F.col("area")).otherwise(0)) / area).alias("root_area_share"),
    )
    a = records.groupBy("case_id", "asset_id").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id").agg(F.count(F.lit(1)).alias("assets"), share(F.col("n") == 1).alias("singleton_share"), F.max("n").alias("_m"))
    p = foreign_assets(records).groupBy("case_id").agg(F.count_if(F.col("error") == "unresolved_parent").alias("missing_parents"), F.count_if(F.col("error") != "unresolved_parent").alias("foreign_parents"))
    x = g.join(a, "case_id").join(p, "case_id", "left").na.fill(0, ["missing_parents", "foreign_parents"])
    return x.withColumn("dominant_share", F.col("_m") / F.col("parts")).drop("_m")


def imbalances(records: DataFrame, image_area: Column) -> DataFrame:
    """(case_id, asset_id, name, instances, smallest, largest) of repeated parts of which one is tiny and another large. The limits."""
    tiny = F.greatest(F.lit(20), F.bround(F.first(image_area) * 0.00012))
    g = records.groupBy("case_id", "asset_id", "name").agg(F.count(F.lit(1)).alias("instances"), F.min("area").alias("smallest"), F.max("area").alias("largest"), tiny.alias("_t"))
    return g.where((F.col("instances") >= 2) & (F.col("smallest") <= F.col("_t")) & (F.col("largest") >= F.greatest(4 * F.col("_t"), F.lit(100))) & (F.col("smallest") / F.greatest("largest", F.lit(1)) < 0.08)).drop("_t")


def package_status(structure: DataFrame, target_ambiguous: Column, many: int = 60) -> DataFrame:
    """``structure`` (as from ``part_structure``) with reasons, status and grade: a broken hierarchy, then an open target, then no
    parts, then reasons for review, else ready. Fixed values: the limits."""
    c = F.col
    why = reasons([
        ("many_generic_parts", c("generic_share") > 0.45), ("many_tiny_parts", c("tiny_share") > 0.35), ("dominant_root_residual", c("root_area_share") > 0.65),
        ("unusually_many_scene_parts", c("parts") > many), ("many_singleton_scene_assets", (c("assets") >= 4) & (c("singleton_share") > 0.6)), ("scene_asset_ownership_imbalance", (c("assets") >= 4) & (c("dominant_share") > 0.7)),
    ])
    broken = c("missing_parents") + c("foreign_parents") > 0
    x = structure.withColumn("reasons", why)
    status = ladder([("invalid_hierarchy", broken), ("target_selection_required", target_ambiguous), ("no_parts_found", c("parts") == 0), ("review_recommended", F.size("reasons") > 0)], "ready")
    return x.withColumn("status", status).withColumn("grade", F.when(c("status") == "ready", "A").when(c("status") == "review_recommended", "B").otherwise("C"))


def target_ambiguous(groups: DataFrame) -> DataFrame:
    """(case_id, ambiguous, margin) of physical groups (case_id, group, name, score): close seconds, or other names not far behind. Fixed values."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "group")
    x = groups.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.lead("score").over(w)).withColumn("_m", F.lead("name").over(w)).where("_n = 1")
    margin = F.col("score") - F.col("_s")
    close = (F.col("_s") >= 0.55) & ((margin <= 0.03) | ((F.col("name") != F.col("_m")) & (margin <= 0.16)))
    return x.select("case_id", F.coalesce(close, F.lit(False)).alias("ambiguous"), margin.alias("margin"))
