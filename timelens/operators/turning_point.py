"""Turning points, user labels and relative time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (AMBIGUOUS_PHRASES, CRISIS_PHRASES, LABEL_PRIORITY, MIN_POSTS, RECOVERY_PHRASES,
                         UNIT_DAYS, WINDOW_UNITS)
from ..functions import text as tx
from ..functions import timefn as tm
from ..functions.skew import skewed_join


@dataclass(frozen=True)
class LabelRules:
    crisis: list[str] = field(default_factory=lambda: list(CRISIS_PHRASES))
    recovery: list[str] = field(default_factory=lambda: list(RECOVERY_PHRASES))
    ambiguous: list[str] = field(default_factory=lambda: list(AMBIGUOUS_PHRASES))
    min_posts: int = MIN_POSTS
    unit_days: int = UNIT_DAYS
    window_units: int = WINDOW_UNITS


def matches(posts: DataFrame, rules: LabelRules) -> DataFrame:
    """Posts holding a phrase, with the winning label and the phrase as written."""
    text = F.col("_text")
    # Most posts have neither kind of phrase: one look at them is enough. An empty list matches every post.
    some = tx.may_have(text, [*rules.crisis, *rules.recovery]) if rules.crisis and rules.recovery else F.lit(True)
    return (posts.select("author", "id", "created_utc", "subreddit", tx.compose("title", "body").alias("_text")).filter(some)
            .withColumn("label", F.when(tx.has_phrase(text, rules.crisis), "crisis")
                        .when(tx.has_phrase(text, rules.recovery), "recovery"))
            .filter(F.col("label").isNotNull())
            .withColumn("phrase", F.when(F.col("label") == "crisis", tx.matched_phrase(text, rules.crisis))
                        .otherwise(tx.matched_phrase(text, rules.recovery)))
            .drop("_text"))


def first_match(posts: DataFrame, rules: LabelRules) -> DataFrame:
    """Earliest matching post per author (ties by id). Only matching posts reach the shuffle."""
    pick = F.min(F.struct("created_utc", "id", "label", "subreddit", "phrase"))
    return (matches(posts, rules).groupBy("author").agg(pick.alias("m"))
            .select("author", F.col("m.label").alias("label"), F.col("m.created_utc").alias("tp_date"),
                    F.col("m.id").alias("tp_post_id"), F.col("m.subreddit").alias("tp_subreddit"),
                    F.col("m.phrase").alias("tp_matched_phrase")))


def author_spans(posts: DataFrame, min_posts: int) -> DataFrame:
    """Post count and first and last time per active author; reads two columns, not the text."""
    return (posts.groupBy("author")
            .agg(F.count(F.lit(1)).alias("n_posts"), F.min("created_utc").alias("first_ts"),
                 F.max("created_utc").alias("last_ts"))
            .filter(F.col("n_posts") > min_posts))


def label_users(posts: DataFrame, rules: LabelRules | None = None) -> DataFrame:
    """One row per active author: label, turning point, confidence and the anchor time.

    A labelled author without a post before ``turning point - 4 units`` is ``neither`` and a
    later match is not tried. ``anchor`` is the turning point, or the last post without one.
    Both inputs are already grouped by author, so the join adds no shuffle.
    """
    rules = rules or LabelRules()
    spans = author_spans(posts, rules.min_posts)
    joined = spans.join(first_match(posts, rules), "author", "left")
    window_us = rules.window_units * tm.unit_micros(rules.unit_days)
    ok = F.coalesce(tm.micros_between(F.col("first_ts"), F.col("tp_date")) > window_us, F.lit(False))
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("tp_post_id", "tp_date", "tp_subreddit", "tp_matched_phrase")]
    return (joined
            .select("author", F.when(ok, F.col("label")).otherwise("neither").alias("label"), "n_posts", *kept,
                    "first_ts", "last_ts")
            .withColumn("low_confidence", low_confidence(F.col("tp_matched_phrase"), rules.ambiguous))
            .withColumn("anchor", F.coalesce("tp_date", "last_ts")))


def low_confidence(phrase: Column, ambiguous: list[str]) -> Column:
    return F.coalesce(F.lower(phrase).isin(ambiguous), F.lit(False))


def pseudo_anchor(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with a missing turning point replaced by the author's last post time."""
    last = posts.groupBy("author").agg(F.max("created_utc").alias("_last"))
    return (labels.join(last, "author", "inner")
            .withColumn("anchor", F.coalesce("tp_date", "_last")).drop("_last"))


def attach_age(posts: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Posts with ``age``: microseconds before the author's anchor (negative after it)."""
    side = labels.select("author", "anchor", *columns)
    joined = skewed_join(posts, side, ["author"])
    return joined.withColumn("age", tm.micros_between(F.col("created_utc"), F.col("anchor")))


def days_to_turning_point(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Timeline with signed days to the turning point; null for authors without one."""
    joined = skewed_join(posts, labels.select("author", "tp_date"), ["author"])
    return joined.withColumn(
        "days_to_tp", tm.micros_between(F.col("tp_date"), F.col("created_utc")) / F.lit(float(tm.DAY_US))).drop("tp_date")


def label_by_priority(tagged: DataFrame, tag_labels: DataFrame) -> DataFrame:
    """Label per author from tag hits; the smallest priority number wins.

    Whether ``tag_labels`` is broadcast is left to its measured size.
    """
    hit = tagged.join(tag_labels, "tag")
    rank = F.create_map(*[x for k, v in LABEL_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    name = F.create_map(*[x for k, v in LABEL_PRIORITY.items() for x in (F.lit(v), F.lit(k))])
    return (hit.groupBy("author").agg(F.min(rank[F.col("label")]).alias("p"))
            .select("author", name[F.col("p")].alias("label")))


def last_post_time(posts: DataFrame) -> DataFrame:
    """Every post next to its author's last post time, by a map-side combined aggregate and a
    join rather than a window that holds a whole author in one task."""
    last = posts.groupBy("author").agg(F.max("created_utc").alias("last_ts"))
    return skewed_join(posts, last, ["author"])
