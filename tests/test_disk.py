"""What a written table leaves on disk."""

import os

from pyspark.sql import functions as F

from timelens import session


def shuffle_files(spark):
    """Data files that shuffles of this session have on disk."""
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in root for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_written_table_leaves_no_shuffle_files(spark):
    """the shuffles of every step lay on disk until the driver collected its garbage."""
    before = shuffle_files(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    kept = spark.conf.get(session.CLEANUP_CONF, None)
    out = session.materialize(df, "sums")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session.CLEANUP_CONF, None) == kept
    # Both the written table and the plan it came from go on giving rows.
    assert out.count() == 100 and sorted(df.collect()) == sorted(out.collect()) and session.materialize(df, "again").count() == 100
