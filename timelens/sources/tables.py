"""Parquet scans and sinks, keyed appends, embedding store, user lists, metric tables, run log."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as tx
from ..functions.skew import first_per_key
from ..schema import METRICS


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_keep_first(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Union where an existing row beats an incoming one, and the first incoming row the rest.

    Copies inside the batch are dropped first, so the anti join meets at most one row a key.
    """
    fresh = first_per_key(incoming, [key], order)
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """Store ``(id, embedding array<float>)``."""
    vectors.select("id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, embedding array<float>").parquet(path)


def read_user_list(spark: SparkSession, path: str) -> DataFrame:
    """One user a line; blanks skipped; a line is a comment only when '#' is its first character."""
    return user_list(spark.read.text(path))


def user_list(lines: DataFrame) -> DataFrame:
    name = tx.strip("value")
    return (lines.filter((F.length(name) > 0) & ~F.col("value").startswith("#"))
            .select(name.alias("author")).distinct())


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Append long metric rows; adaptive execution joins them into few files after all tasks have computed them."""
    (metrics.select(*[F.col(f.name).cast(f.dataType) for f in METRICS.fields])
     .hint("rebalance").write.mode("append").format(fmt).save(path))


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(METRICS).format(fmt).load(path)


def _create_if_absent(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False where it is there already. Of several callers at once exactly one gets True.

    The name node (or a store with conditional writes) decides on a cluster; on a local disk the operating system does,
    because the local file system class of the cluster libraries looks first and creates afterwards.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(target, False).close()
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise


def claim_run(spark: SparkSession, path: str) -> int:
    """The next free run number of the log at ``path``, claimed for this writer alone."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
    run = max(taken, default=0) + 1
    while not _create_if_absent(spark, f"{folder.toString()}/{run}"):
        run += 1
    return run


def append_run(spark: SparkSession, path: str, run: DataFrame) -> DataFrame:
    """Append one run summary (one row) under a claimed number and return the log; writers may run at the same time.

    Numbers count up from 1 and are never given twice. A writer that dies between claim and write leaves its number
    unused; a row is seen whole or not at all, because only its own folder ``run=N`` is written.
    """
    number = claim_run(spark, path)
    run.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={number}")
    return read_runs(spark, path, run.schema)


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log with its ``run`` numbers; fields that a run does not have are null."""
    wanted = StructType([*schema.fields, StructField("run", LongType())])
    return spark.read.schema(wanted).option("basePath", path).parquet(path)
