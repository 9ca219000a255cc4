"""Sinks: packages with a manifest, CSV with the union of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .readers import hashed_files


def package(tables: dict[str, DataFrame], folder: str, partition: str = "case_id") -> DataFrame:
    """Write tables as Parquet under ``folder`` and return the manifest (path, bytes, sha256) of what was written."""
    for name, rows in tables.items():
        w = rows.write.mode("overwrite")
        (w.partitionBy(partition) if partition in rows.columns else w).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return hashed_files(spark, folder).where(~F.col("path").rlike(r"(^|/)[._]"))


def union_csv(parts: list[DataFrame], path: str) -> None:
    """All rows under the sorted union of columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode("overwrite").option("header", True).csv(path)


def json_safe(rows: DataFrame, name: str = "json") -> DataFrame:
    """One column of JSON texts; numbers that JSON doesn't have (infinite, not a number) become null."""
    safe = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c)
    cols = [safe(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def summary(rows: DataFrame, folder: str, key: str = "case_id") -> DataFrame:
    """All cases of a benchmark after this run: the folder's rows, with ``rows`` in place of those of the same key.

    Written beside; then the old folder is moved aside, the new one moved in and the old one deleted, so that at any time
    one of them is whole. What a failed run has left aside is read if the folder isn't there.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda suffix: spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + suffix)
    new, old = path("-new"), path("-old")
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)
    out = rows
    if fs.exists(at):
        before = spark.read.parquet(folder)
        out = before.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    out.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not move {folder} aside")
    if not fs.rename(new, at):
        raise OSError(f"could not move the new rows to {folder}")
    fs.delete(old, True)
    return spark.read.parquet(folder)


def audit(candidates: DataFrame, folder: str) -> None:
    """Candidates of each case, numbered from 1 by score, one folder per case, sorted by number inside files."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "candidate_index")
    candidates = candidates.withColumn("candidate_index", F.row_number().over(w))
    candidates.repartition("case_id").sortWithinPartitions("case_id", "candidate_index").write.mode("overwrite").partitionBy("case_id").parquet(folder)
