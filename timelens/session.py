"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's own setting: the shuffle files of a job go when the job is done.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "timelens", master: str | None = None, shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    """Build a session with the settings the library relies on.

    UTC session time and adaptive execution are always on. ``shuffle_partitions`` is for
    local runs only: on a cluster leave it unset and let adaptive execution coalesce the
    deployment's own (large) setting.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the deployment names in ``spark.checkpoint.dir``.

    Every executor must see the folder, so the setting is read from the session. A local
    folder is made only when the setting is absent and the session runs in one JVM.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="timelens-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, compression: str | None = None, file_rows: int = 0):
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where one result feeds several actions: lineage ends at durable files, so a lost
    executor costs a re-read rather than a recompute. The shuffle files of the write serve nothing after it and go with it, so
    the disk that a query takes is that of its largest step, not of all steps. ``compression`` takes the place of the session's Parquet codec.
    ``file_rows`` is the most rows of a file, for tables of very long rows: Spark's reader holds some thousand rows of a file at once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)
