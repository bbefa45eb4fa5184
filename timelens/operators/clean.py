"""Cleaning, cohort filters and per-user caps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DELETED_MARKERS, MIN_POSTS
from ..functions import text as tx
from ..functions.skew import first_n_per_key, skewed_join


# A body that is only a deleted marker and white space.
DELETED_BODY = r"(?U)\A\s*(?:" + "|".join(re.escape(m) for m in DELETED_MARKERS) + r")\s*\z"


def parse_time(col: str | Column) -> Column:
    """Lenient timestamp: text that does not parse becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def clean_posts(posts: DataFrame) -> DataFrame:
    """Keep posts with an author, a time and a body that is neither blank nor a deleted marker."""
    return (posts.dropna(subset=["author", "body", "created_utc"])
            .filter(~F.col("author").isin(DELETED_MARKERS))
            .filter(F.col("body").rlike(r"(?U)\S") & ~F.col("body").rlike(DELETED_BODY)))


def active_authors(posts: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    """Authors with strictly more than ``min_posts`` posts. Reads the author column only."""
    return (posts.groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"))
            .filter(F.col("n_posts") > min_posts))


def keep_authors(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Semi join on author; adaptive execution splits a hot author over many tasks."""
    return skewed_join(posts, authors.select("author").distinct(), ["author"], "left_semi")


def active_posts(posts: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    return keep_authors(posts, active_authors(posts, min_posts))


def labelled_posts(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts of authors labelled crisis or recovery."""
    return keep_authors(posts, labels.filter(F.col("label").isin("crisis", "recovery")))


def high_confidence(users: DataFrame) -> DataFrame:
    return users.filter(~((F.col("label") == "recovery") & F.coalesce(F.col("low_confidence"), F.lit(False))))


def usable_posts(posts: DataFrame, min_posts: int, max_posts: int, min_chars: int = 10) -> DataFrame:
    """Posts with enough text, of users with enough such posts, oldest ``max_posts`` per user."""
    usable = (posts.withColumn("text", tx.compose("title", "body", trim=True))
              .filter(F.length("text") > min_chars))
    enough = active_authors(usable, min_posts - 1)
    capped = first_n_per_key(usable, ["author"], [F.col("created_utc"), F.col("id")], max_posts)
    return skewed_join(capped, enough.select("author"), ["author"], "left_semi")


def cap_per_kind(posts: DataFrame, kind: str, max_posts: int) -> DataFrame:
    """At most ``max_posts`` oldest rows per author and kind."""
    return first_n_per_key(posts, ["author", kind], [F.col("created_utc"), F.col("id")], max_posts)


def reproducible_sample(posts: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in a hashed order: the same rows whatever the partitioning."""
    from ..functions.skew import seeded_order
    return posts.withColumn("_h", seeded_order("id", seed)).orderBy("_h", "id").limit(n).drop("_h")
