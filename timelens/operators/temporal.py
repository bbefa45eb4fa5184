"""Posting-rhythm features: hour entropy, night and weekend shares, gaps between posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TEMPORAL, UNIT_DAYS, WINDOWS
from ..functions import timefn as tm
from .linguistic import add_deltas
from .turning_point import attach_age


def hour_profile(aged: DataFrame, unit_days: int) -> DataFrame:
    """Entropy over hours and night and weekend shares.

    Counts per (author, hour, weekend) hold at most 48 rows an author, whatever the author
    posts, and a second aggregate folds them for all windows at once.
    """
    flags = tm.window_flags(F.col("age"), unit_days)
    hourly = (aged.withColumn("hour", F.hour("created_utc"))
              .withColumn("weekend", F.weekday("created_utc") >= 5)
              .groupBy("author", "hour").agg(
                  *[F.count(F.when(c, 1)).alias(f"c_{w}") for w, c in flags.items()],
                  *[F.count(F.when(c & F.col("weekend"), 1)).alias(f"we_{w}") for w, c in flags.items()]))
    aggs = []
    for w in WINDOWS:
        c = F.col(f"c_{w}")
        aggs += [F.sum(c).alias(f"n_{w}"),
                 F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)).alias(f"clog_{w}"),
                 F.sum(F.when(F.col("hour") < 4, c).otherwise(0)).alias(f"night_{w}"),
                 F.sum(f"we_{w}").alias(f"wk_{w}")]
    folded = hourly.groupBy("author").agg(*aggs)
    cols = []
    for w in WINDOWS:
        n = F.col(f"n_{w}")
        cols += [F.when(n > 0, (F.log2(n) - F.col(f"clog_{w}") / n) / F.log2(F.lit(24.0))).alias(f"hour_entropy_{w}"),
                 F.when(n > 0, F.col(f"night_{w}") / n).alias(f"late_night_rate_{w}"),
                 F.when(n > 0, F.col(f"wk_{w}") / n).alias(f"weekend_rate_{w}")]
    return folded.select("author", *cols)


def gaps(aged: DataFrame, chunk_us: int) -> DataFrame:
    """Consecutive post pairs as ``(author, age, prev_age)`` without one sort per author.

    Lag runs inside (author, chunk of time). The pair that crosses a chunk border comes from
    the chunks' first and last posts, one row a chunk, so a very active author is spread over
    as many tasks as it has chunks.
    """
    chunked = aged.select("author", "id", "age", tm.back_bucket(F.col("age"), chunk_us).alias("chunk"))
    inner = Window.partitionBy("author", "chunk").orderBy(F.col("age").desc(), "id")
    within = (chunked.withColumn("prev_age", F.lag("age").over(inner))
              .filter(F.col("prev_age").isNotNull()).select("author", "age", "prev_age"))
    ends = chunked.groupBy("author", "chunk").agg(F.max("age").alias("oldest"), F.min("age").alias("newest"))
    outer = Window.partitionBy("author").orderBy(F.col("chunk").desc())
    across = (ends.withColumn("prev_age", F.lag("newest").over(outer))
              .filter(F.col("prev_age").isNotNull())
              .select("author", F.col("oldest").alias("age"), "prev_age"))
    return within.unionByName(across)


def gap_stats(aged: DataFrame, unit_days: int) -> DataFrame:
    """Mean, sample deviation and maximum gap in hours; both ends of a gap lie in the window."""
    pairs = gaps(aged.filter(F.col("age") > 0), tm.unit_micros(unit_days))
    here = tm.window_flags(F.col("age"), unit_days)
    before = tm.window_flags(F.col("prev_age"), unit_days)
    hours = (F.call_function("div", F.col("prev_age") - F.col("age"), F.lit(1_000_000)) / F.lit(3600.0))
    aggs = []
    for w in WINDOWS:
        inside = F.when(here[w] & before[w], F.col("hours"))
        aggs += [F.avg(inside).alias(f"interval_mean_hr_{w}"), F.stddev_samp(inside).alias(f"interval_std_hr_{w}"),
                 F.max(inside).alias(f"max_gap_hr_{w}")]
    return pairs.withColumn("hours", hours).groupBy("author").agg(*aggs)


def temporal_windows(posts: DataFrame, labels: DataFrame, unit_days: int = UNIT_DAYS) -> DataFrame:
    aged = attach_age(posts.select("author", "id", "created_utc"), labels)
    joined = hour_profile(aged, unit_days).join(gap_stats(aged, unit_days), "author", "left")
    return joined.select("author", *[f"{f}_{w}" for w in WINDOWS for f in TEMPORAL])


def temporal_features(posts: DataFrame, labels: DataFrame, unit_days: int = UNIT_DAYS) -> DataFrame:
    return add_deltas(temporal_windows(posts, labels, unit_days), TEMPORAL)
