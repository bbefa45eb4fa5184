"""Change points in short weekly series and their distance to the turning point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefn as tm
from ..constants import CP_JUMP, CP_MIN_SEGMENT, CP_MIN_WEEKS, CP_PENALTY


def segment(values: np.ndarray, penalty: float, min_segment: int, jump: int) -> list[int]:
    """Borders that minimise squared error plus ``penalty`` per segment.

    Borders lie on multiples of ``jump`` and segments hold ``min_segment`` points or more.
    Prefix sums price a segment in constant time.
    """
    n = len(values)
    s1 = np.concatenate([[0.0], np.cumsum(values)])
    s2 = np.concatenate([[0.0], np.cumsum(values * values)])
    ends = [k for k in range(jump, n, jump) if k >= min_segment] + [n]
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    for end in ends:
        starts = np.array([s for s in best if end - s >= min_segment], dtype=int)
        if not len(starts):
            continue
        size = end - starts
        total = s1[end] - s1[starts]
        cost = np.array([best[s][0] for s in starts]) + (s2[end] - s2[starts] - total * total / size) + penalty
        i = int(np.argmin(cost))
        best[end] = (float(cost[i]), int(starts[i]))
    found, at = [], n
    while at > 0 and at in best:
        at = best[at][1]
        if at > 0:
            found.append(at)
    return found[::-1]


def segmenter(penalty: float, min_segment: int, jump: int):
    """Function: list of series -> borders of each, as ``segment`` finds them, for many series in the same steps. It travels with its tasks.

    Borders inside lie on a grid that all series share, so the best cost of a grid point is found for all series at once; only the last
    segment ends where its series ends. Prices are made by the same operations in the same order as there.
    """
    def some(rows: list[np.ndarray]) -> list[list[int]]:
        n = np.array([len(r) for r in rows])
        # Grid points 0, jump, 2 * jump, ... below the longest end; each series uses those below its own.
        grid = np.arange(0, max(int(n.max()), 1), jump)
        values = np.zeros((len(rows), int(n.max()) + 1))
        for i, r in enumerate(rows):
            values[i, 1:len(r) + 1] = r
        s1, s2 = np.cumsum(values, axis=1), np.cumsum(values * values, axis=1)
        at = np.arange(len(rows))
        e1, e2 = s1[at, n][:, None], s2[at, n][:, None]
        s1, s2 = s1[:, grid], s2[:, grid]
        best, back = np.zeros((len(rows), len(grid))), np.zeros((len(rows), len(grid)), int)
        usable = (grid == 0) | (grid >= min_segment)
        for k in range(1, len(grid)):
            starts = np.flatnonzero(usable[:k] & (grid[k] - grid[:k] >= min_segment))
            if not len(starts):
                continue
            total = s1[:, [k]] - s1[:, starts]
            cost = best[:, starts] + (s2[:, [k]] - s2[:, starts] - total * total / (grid[k] - grid[starts])) + penalty
            i = np.argmin(cost, axis=1)
            best[:, k], back[:, k] = cost[at, i], starts[i]
        size = n[:, None] - grid
        open_ = usable & (size >= max(min_segment, 1))
        total = e1 - s1
        cost = best + (e2 - s2 - total * total / np.maximum(size, 1)) + penalty
        last = np.argmin(np.where(open_, cost, np.inf), axis=1)
        out = []
        for i in range(len(rows)):
            found, k = [], int(last[i]) if open_[i].any() else 0
            while k > 0:
                found.append(int(grid[k]))
                k = int(back[i, k])
            out.append(found[::-1])
        return out

    def borders(rows: list[np.ndarray], at_once: int = 1 << 18) -> list[list[int]]:
        # Series of like length share a matrix of a bounded number of elements.
        order, out = sorted(range(len(rows)), key=lambda i: len(rows[i])), [[] for _ in rows]
        while order:
            count = max(1, at_once // (len(rows[order[-1]]) + 1))
            part, order = order[-count:], order[:-count]
            for i, found in zip(part, some([rows[i] for i in part])):
                out[i] = found
        return out
    return borders


def change_points(series: DataFrame, penalty: float = CP_PENALTY, min_weeks: int = CP_MIN_WEEKS,
                  min_segment: int = CP_MIN_SEGMENT, jump: int = CP_JUMP) -> DataFrame:
    """Change weeks per author from ``(author, week, value)``; short series are left out.

    An author's series holds one value a week, so it is packed into one array and segmented
    in Arrow batches of many authors at once.
    """
    packed = (series.groupBy("author")
              .agg(F.array_sort(F.collect_list(F.struct("week", "value"))).alias("s"))
              .select("author", F.transform("s", lambda x: x["week"]).alias("weeks"),
                      F.transform("s", lambda x: x["value"]).alias("vals"))
              .filter(F.size("vals") >= min_weeks))

    many = segmenter(penalty, min_segment, jump)

    @F.pandas_udf("array<int>")
    def borders(vals: pd.Series) -> pd.Series:
        return pd.Series(many([np.asarray(v, dtype=float) for v in vals]), dtype=object)

    return (packed.withColumn("cps", borders("vals"))
            .select("author", F.size("vals").alias("n_weeks"), F.size("cps").alias("n_cps"),
                    F.transform("cps", lambda i: F.element_at("weeks", i + 1)).alias("cp_weeks")))


def nearest_distance(cps: DataFrame, labels: DataFrame) -> DataFrame:
    """Weeks from the turning point to the nearest change point, in whole days over seven.

    The signed distance is rounded down to days before its size is taken. Infinite without a change point, null without a turning point.
    """
    joined = cps.join(labels.select("author", "label", "tp_date"), "author")
    days = F.transform("cp_weeks", lambda w: F.abs(F.floor(tm.micros_between(F.col("tp_date"), w) / F.lit(tm.DAY_US))))
    dist = (F.when(F.size("cp_weeks") == 0, F.lit(float("inf")))
            .when(F.col("tp_date").isNull(), F.lit(None).cast("double"))
            .otherwise(F.array_min(days) / F.lit(7.0)))
    return joined.select("author", "label", "n_weeks", "n_cps", dist.alias("distance"))


def hit_rates(distances: DataFrame, tolerances: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Hit shares over all users, over users with a change point, per label, and the random rate."""
    d = F.col("distance")
    has = d != float("inf")
    aggs = [F.count(F.lit(1)).alias("n_users"), F.count(F.when(F.col("n_cps") > 0, 1)).alias("users_with_cp"),
            F.avg("n_cps").alias("mean_cps"), F.avg("n_weeks").alias("mean_weeks")]
    for k in tolerances:
        hit = F.coalesce(d <= k, F.lit(False)).cast("double")
        aggs += [F.avg(hit).alias(f"hit_all_{k}"), F.avg(F.when(F.coalesce(has, F.lit(True)), hit)).alias(f"hit_with_cp_{k}")]
    out = (distances.rollup("label").agg(*aggs).withColumn("label", F.coalesce("label", F.lit("all"))))
    return out.select("*", *[(2.0 * k / F.col("mean_weeks")).alias(f"random_{k}") for k in tolerances])
