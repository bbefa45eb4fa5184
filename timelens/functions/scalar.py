"""Small numeric column builders shared by matching, ranking and verification."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CROSSES, ENGAGEMENT_DEFAULT, ENGAGEMENT_WEIGHTS


def softmax(cols: list[Column], temperature: float) -> list[Column]:
    top = F.greatest(*cols)
    exps = [F.exp((c - top) / temperature) for c in cols]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def overlap(asked: Column, offered: Column, when_empty: float) -> Column:
    """Share of the distinct asked items that are offered."""
    wanted = F.array_distinct(asked)
    return (F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, offered)) / F.size(wanted))
            .otherwise(when_empty))


def points(weight: int, share: Column) -> Column:
    """Truncated share of a point budget."""
    return F.floor(weight * share).cast("int")


def engagement(kind: Column, rating: Column) -> Column:
    """Rating scaled to [0, 1], else a weight by type; a rating event without a rating is null."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ENGAGEMENT_WEIGHTS.items()))
    by_type = F.when(kind == "rate", F.lit(None).cast("double")).otherwise(
        F.coalesce(F.try_element_at(table, kind), F.lit(ENGAGEMENT_DEFAULT)))
    return F.when(rating.isNotNull(), (rating.cast("double") - 1.0) / 4.0).otherwise(by_type)


def number(text: Column) -> Column:
    """A number from its JSON text or from text; null if it is none (or not finite)."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def whole(text: Column) -> Column:
    """A whole number from number text, fractions cut off; exact for whole text of any size."""
    return F.coalesce(text.try_cast("bigint"), number(text).try_cast("bigint"))


def truthy(text: Column) -> Column:
    """A flag from its JSON text: false, zero, empty and missing values are false."""
    return F.coalesce(~F.lower(text).isin("", "false", "null", "[]", "{}") & (F.coalesce(number(text), F.lit(1.0)) != 0), F.lit(False))


def joined(text: Column, sep: str = ", ") -> Column:
    """A list's members joined, from the JSON text of a list; other text stays as it is."""
    members = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), F.coalesce(F.array_join(members, sep), text)).otherwise(text)


def cross_features() -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(name) for a, b, name in CROSSES]


def flag(cond: Column) -> Column:
    """Boolean to 1.0 / 0.0 with null as 0.0."""
    return F.when(cond, 1.0).otherwise(0.0)
