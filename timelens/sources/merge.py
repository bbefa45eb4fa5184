"""Merging of sources into one timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import first_per_key


def tag_sources(sources: list[tuple[str, DataFrame | None, DataFrame | None]]) -> list[tuple[DataFrame, DataFrame]]:
    """Rows tagged with source and priority; a source counts only when both its tables exist."""
    kept = []
    for rank, (name, posts, labels) in enumerate(sources):
        if posts is None or labels is None:
            continue
        kept.append(tuple(df.withColumn("source", F.lit(name)).withColumn("_prio", F.lit(rank)) for df in (posts, labels)))
    return kept


def union_sources(sources: list[tuple[str, DataFrame | None, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Tagged union of posts and of labels, missing columns as null."""
    kept = tag_sources(sources)
    if not kept:
        raise ValueError("no source has both posts and labels")
    posts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p, _ in kept])
    labels = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [l for _, l in kept])
    return posts, labels


def row_digest(df: DataFrame) -> Column:
    """A digest of the whole row, the same in every run: it settles which of otherwise equal rows comes first."""
    return F.md5(F.to_json(F.struct(*sorted(df.columns))))


def merge_sources(sources: list[tuple[str, DataFrame | None, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Union in which the first source wins per post id and per author; equal rows of a source are ordered by their digest."""
    posts, labels = union_sources(sources)
    order = [F.col("_prio"), F.col("created_utc")]
    return (first_per_key(posts, ["id"], [*order, row_digest(posts)]).drop("_prio"),
            first_per_key(labels, ["author"], [F.col("_prio"), row_digest(labels)]).drop("_prio"))
