"""Join and ordering helpers that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows that one window of running sums sorts; the number of windows follows the rows without a ceiling.
CHUNK_ROWS = 250_000


def skewed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a key may hold a large share of ``big`` and ``small`` has one row a key.

    Adaptive execution decides by measured sizes: a small side is broadcast, and a hot partition of ``big`` is split over
    tasks that each read the one row of ``small``. Nothing is copied for keys that are not hot.
    """
    return big.join(small, keys, how)


def in_order(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows in global order, written once, each with its range partition ``_slice`` and its place ``_at`` from 0 inside it.

    Spark samples the range bounds and adaptive execution joins small neighbours, so tasks follow the bytes and nothing is
    counted first. Bounds differ from run to run, hence the table is written before anything is derived from it. Rows that
    are equal in all of ``order`` are split by the task they come from, so a hot value is no task of its own. ``parts``
    sets the number of ranges by hand.
    """
    keys = [*order, "_from"]
    tagged = df.withColumn("_from", F.spark_partition_id())
    ranges = tagged.repartitionByRange(parts, *keys) if parts else tagged.repartitionByRange(*keys)
    # The low 33 bits of the id count the rows of a task; after the sort that is the place in the slice.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(ranges.sortWithinPartitions(*keys).select(
        *df.columns, F.spark_partition_id().alias("_slice"), place.alias("_at")), "in_order")


def _before(totals: DataFrame, group: list[str], order: list[str], values: list[str]) -> list[Column]:
    """Sums of ``values`` over the earlier totals of the group: one row a slice or chunk is all that is sorted here."""
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)
    back = over.rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(v).over(back), F.lit(0)) for v in values]


def running_totals(df: DataFrame, group: list[str], order: str, values: list[str], parts: int | None = None,
                   prefix: str = "before_", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact sums of ``values`` over rows of the group strictly below the current ``order``.

    ``df`` holds one row per (group, order). A window over a whole group would sort it in one task; here the rows lie in
    range partitions, each cut into chunks of ``chunk_rows``. A prefix pass over the totals of chunks gives each its
    offset, and a window runs inside each chunk.
    """
    placed = in_order(df, [*group, order], parts).withColumn("_chunk", F.floor(F.col("_at") / chunk_rows))
    keys = [*group, "_slice", "_chunk"]
    totals = placed.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    sums = _before(totals, group, ["_slice", "_chunk"], [f"_t_{v}" for v in values])
    offsets = totals.select(*keys, *[s.alias(f"_o_{v}") for s, v in zip(sums, values)])
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(placed, offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{prefix}{v}") for v in values])


def ranked(df: DataFrame, group: list[str], order: str, tie: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Row number inside each group by (``order``, ``tie``): one range shuffle, no window over rows.

    A row's number is its place in its slice, less the place where its group starts there, plus the rows that the group
    has in earlier slices. Rows equal in group, order and tie get different numbers in no fixed order.
    """
    placed = in_order(df, [*group, order, tie], parts)
    keys = [*group, "_slice"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.select(*keys, (_before(sizes, group, ["_slice"], ["_n"])[0] - F.col("_first") + 1).alias("_o"))
    return null_safe_join(placed, offsets, keys).select(*df.columns, (F.col("_at") + F.col("_o")).alias(name))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key by an explicit order.

    The ``<= 1`` filter on a row number lets Spark drop losers inside each map task before
    the shuffle, so a key with very many copies sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def seeded_order(key: str | Column, seed: int | Column) -> Column:
    """Reproducible 60-bit shuffle key, the same in any engine that has md5."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", k.cast("string"), seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def seeded_uniform(key: str | Column, seed: int | Column) -> Column:
    """Reproducible uniform in [0, 1) with 32 bits."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", k.cast("string"), seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
