"""Assembly of the per-author feature matrix and of per-author documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LINGUISTIC, METADATA, PRE_WINDOWS, WINDOWS
from ..functions import text as tx

RAW_COLUMNS = ([f"{f}_{w}" for f in LINGUISTIC for w in WINDOWS] + [f"{f}_delta_{w}" for f in LINGUISTIC for w in PRE_WINDOWS]
               + [f"has_posts_{w}" for w in PRE_WINDOWS])


def presence_flags(wide: DataFrame) -> DataFrame:
    """``has_posts_<window>`` from the posting rate, unless the column is there already."""
    cols = [(F.col(f"post_freq_{w}") > 0).cast("double").alias(f"has_posts_{w}") for w in PRE_WINDOWS
            if f"has_posts_{w}" not in wide.columns and f"post_freq_{w}" in wide.columns]
    return wide.select("*", *cols)


def feature_columns(wide: DataFrame) -> list[str]:
    """Numeric and boolean columns that are not metadata, read from the schema."""
    return [f.name for f in wide.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in METADATA]


def select_family(wide: DataFrame, family: str = "all") -> list[str]:
    """``all`` prefers the full raw list when present; ``deltas`` keeps deltas and presence."""
    found = feature_columns(wide)
    if family == "deltas":
        return [c for c in found if "_delta_" in c or c.startswith("has_posts_")]
    return RAW_COLUMNS if all(c in wide.columns for c in RAW_COLUMNS) else found


def join_families(base: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Inner join of families on author; columns already present are dropped from the right.

    Every family is grouped by author, so the chain needs no shuffle beyond theirs.
    """
    def add(left, right):
        extra = [c for c in right.columns if c == "author" or c not in left.columns]
        return left.join(right.select(*extra), "author", "inner")
    return reduce(add, others, base)


def with_metadata(wide: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.select("author", "label", "low_confidence", "n_posts", "tp_date").join(wide, "author")


def user_documents(posts: DataFrame) -> DataFrame:
    """All texts of an author in time order, white space collapsed.

    A document is one string and so is bounded by what one row may hold; counting features
    over an author's text use per-post rows instead.
    """
    doc = tx.collapse_space(tx.compose("title", "body"))
    ordered = F.array_sort(F.collect_list(F.struct("created_utc", "id", doc.alias("doc"))))
    return posts.groupBy("author").agg(F.array_join(F.transform(ordered, lambda s: s["doc"]), " ").alias("doc"))
