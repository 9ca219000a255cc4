"""Reading tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on local masters a temporary folder, removed at exit, if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="loomgrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


#: Rows and bytes of an Arrow batch while a table is written; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


@contextlib.contextmanager
def lean_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES, compact: bool = False) -> Iterator[None]:
    """Inside the block this session's Arrow batches are bounded by rows and by bytes; the settings then return.

    compact: shuffled partitions are merged up to the advisory size, so that small tables are few files.
    """
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    if compact:
        most["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
    before = {k: spark.conf.get(k, None) for k in most}
    for k, v in most.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Scratch:
    """Tables that are written inside a ``with`` block, deleted at its end unless ``keep`` names them.

    Kept ones belong to the block around it, if there is one. With ``delete=False`` they stay, and ``delete`` can be
    called once what was made from them is written.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, delete: bool = True):
        self.spark, self.at_end, self.tables = spark, delete, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *failed) -> None:
        Scratch._open.remove(self)
        if self.at_end:
            self.delete()

    def keep(self, df: DataFrame) -> DataFrame:
        path = df._loomgrid_table
        self.tables.remove(path)
        around = Scratch._open[: Scratch._open.index(self)]
        if around:
            around[-1].tables.append(path)
        return df

    def delete(self) -> None:
        for path in self.tables:
            delete_table(self.spark, path)
        self.tables = []


def delete_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, with bounded Arrow batches, and read it back, so later stages start from files.

    compact: for results that are cheap to make once shuffled; small ones are then few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid/{uuid.uuid4().hex}/{label}"
    with lean_batches(spark, compact=compact):
        df.write.parquet(path)
    if Scratch._open:
        Scratch._open[-1].tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgrid_table = path
    return out


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Keys with more rows are hot; so many hot keys are broadcast.
HOT_ROWS, HOT_KEYS = 500, 200_000


def meet(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``, a written table of one row a key with its number of ``rows``.

    There are at most all rows / HOT_ROWS hot keys; these are broadcast, so that no task gets all rows of one. Beyond
    HOT_KEYS of them both sides are shuffled, and adaptive execution splits skewed partitions.
    """
    hot = per_key.where(F.col("rows") > HOT_ROWS)
    if not 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(per_key, on, how)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(per_key.where(F.col("rows") <= HOT_ROWS), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
