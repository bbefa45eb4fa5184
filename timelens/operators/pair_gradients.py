"""Ranking weights from all pairs of rows with different labels, for any number of distinct labels.

The gradient of row i sums ``(y_i - y_j) * s(p_i - p_j)`` over rows with smaller labels and its mirror over larger ones, with s a
logistic curve. Rows in label order are cut into chunks. Pairs inside a chunk are summed one by one. Between chunks the curve is a short
Chebyshev series in both predictions once these are cut into cells of width ``1 / sigma``: a chunk's part of a cell is 16 moments, a cell
reaches another by one fixed matrix a distance, and running sums over chunks give everything below and above. Equal labels cancel by
their factor ``y_i - y_j``, so a label with many rows may lie in many chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import in_order, running_totals
from ..session import materialize

#: Terms of the series, cells beyond which the curve is 0 or 1 to the last bit of a double, distinct rows a chunk.
TERMS, REACH, CHUNK = 16, 40, 512


def _transfer() -> np.ndarray:
    """``[d + REACH, a, b]``: coefficients of ``1 / (1 + exp(x - q))`` for x in a cell that lies d cells above that of q."""
    nodes = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
    basis = np.cos(np.arange(TERMS)[:, None] * np.arccos(nodes)) * (2.0 / TERMS)
    basis[0] /= 2
    place = (nodes + 1) / 2
    return np.stack([basis @ (1 / (1 + np.exp(d + place[:, None] - place[None, :]))) @ basis.T for d in range(-REACH, REACH + 1)])


def _series(t: np.ndarray) -> np.ndarray:
    return np.cos(np.arange(TERMS)[None, :] * np.arccos(np.clip(t, -1, 1))[:, None])


def _sum_of(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def pair_gradients(df: DataFrame, truth: str, pred: str, group: str, sigma: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """``(group, truth, pred, lam)`` for every distinct triple; rows with a null or non-finite label or prediction take no part.

    Work is linear in the distinct triples, times the cells in reach that hold rows (one or two for predictions between 0 and 1).
    Moments, masses and chunks go through range partitions, so neither a hot group nor a hot label is a task of its own.
    """
    y, p = F.col("_y"), F.col("_p")
    finite = (F.abs("_y") < float("inf")) & (F.abs("_p") < float("inf"))
    entries = (df.select(F.col(group).alias("_g"), F.col(truth).cast("double").alias("_y"), F.col(pred).cast("double").alias("_p")).where(finite)
               .groupBy("_g", "_y", "_p").agg(F.count(F.lit(1)).cast("double").alias("_c")))
    placed = in_order(entries, ["_g", "_y", "_p"]).select(
        "_g", "_y", "_p", "_c", (F.shiftleft(F.col("_slice").cast("long"), 33) + F.floor(F.col("_at") / chunk)).alias("_b"), F.floor(p * sigma).cast("long").alias("_k"))
    t = 2.0 * (p * sigma - F.col("_k")) - 1.0
    names = [f"{kind}{b}" for kind in "mw" for b in range(TERMS)]
    curve = [F.cos(b * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), t)))) for b in range(TERMS)]
    moments = materialize(placed.groupBy("_g", "_b", "_k").agg(
        *[F.sum(F.col("_c") * curve[b]).alias(f"m{b}") for b in range(TERMS)], *[F.sum(F.col("_c") * y * curve[b]).alias(f"w{b}") for b in range(TERMS)]), "moments")

    # What every cell receives from the cells in reach, as series of its own, chunk by chunk.
    width = 2 * REACH + 1
    cells = moments.groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_chunks"))
    blocks = cells.groupBy("_g", F.floor(F.col("_k") / width).alias("_w")).agg(F.collect_list("_k").alias("_ks"))
    reached = F.array_distinct(F.array(F.floor((F.col("_k") - REACH) / width), F.floor((F.col("_k") + REACH) / width)))
    sent = (null_safe(moments.withColumn("_w", F.explode(reached)), blocks, ["_g", "_w"])
            .select("_g", "_b", F.col("_k").alias("_from"), *names, F.explode(F.filter("_ks", lambda k: F.abs(k - F.col("_k")) <= REACH)).alias("_k")))
    table = _transfer()

    def pass_on(batches):
        for pdf in batches:
            m = table[(pdf["_k"] - pdf["_from"]).to_numpy() + REACH]
            v = pdf[names].to_numpy().reshape(len(pdf), 2, TERMS)
            out = pdf[["_g", "_b", "_k"]].copy()
            out[names] = np.einsum("nab,nkb->nka", m, v).reshape(len(pdf), -1)
            yield out

    keys = [f for f in sent.schema.fields if f.name in ("_g", "_b", "_k")]
    shape = T.StructType([next(f for f in keys if f.name == c) for c in ("_g", "_b", "_k")] + [T.StructField(n, T.DoubleType()) for n in names])
    # Every chunk that holds rows of a cell asks there, so it is present with zeros at least.
    heard = materialize(sent.select("_g", "_b", "_k", "_from", *names).mapInPandas(pass_on, shape).groupBy("_g", "_k", "_b").agg(*_sum_of(names)), "heard")
    curves = _around(heard, ["_g", "_k"], names)
    curves = null_safe(curves, moments.select("_g", "_b", "_k"), ["_g", "_b", "_k"])
    curves = _with_far(curves, moments.select("_g", "_b", "_k", F.col("m0").alias("fm"), F.col("w0").alias("fw")))
    mass = _around(moments.groupBy("_g", "_b").agg(F.sum("m0").alias("am"), F.sum("w0").alias("aw")), ["_g"], ["am", "aw"])
    curves = null_safe(curves, mass.select("_g", "_b", "over_am", "over_aw"), ["_g", "_b"])

    sides = [[f"{side}_{kind}{b}" for b in range(TERMS)] for side in ("under", "over") for kind in "mw"]

    def settle(key, rows: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("_k")
        at = np.searchsorted(cell["_k"].to_numpy(), rows["_k"].to_numpy())
        x, label, n = rows["_p"].to_numpy() * sigma, rows["_y"].to_numpy(), rows["_c"].to_numpy()
        basis = _series(2 * (x - rows["_k"].to_numpy()) - 1)
        low0, low1, high0, high1 = ((basis * cell[s].to_numpy()[at]).sum(1) + cell[f].to_numpy()[at]
                                    for s, f in zip(sides, ("under_fm", "under_fw", "over_fm", "over_fw")))
        total0, total1 = cell["over_am"].to_numpy()[at], cell["over_aw"].to_numpy()[at]
        lam = -(label * low0 - low1) + (total1 - label * total0) - (high1 - label * high0)
        gap = label[:, None] - label[None, :]
        share = 1 / (1 + np.exp(np.minimum(x[:, None] - x[None, :], 700.0)))
        lam += (-gap * np.where(gap > 0, share, np.where(gap < 0, 1 - share, 0.0)) * n[None, :]).sum(1)
        return pd.DataFrame({"_g": rows["_g"], "_y": rows["_y"], "_p": rows["_p"], "lam": lam * sigma})

    rows = placed.select("_g", "_y", "_p", "_c", "_b", "_k")
    done = (rows.groupBy("_b", "_g").cogroup(curves.groupBy("_b", "_g"))
            .applyInPandas(settle, T.StructType([placed.schema["_g"], T.StructField("_y", T.DoubleType()), T.StructField("_p", T.DoubleType()), T.StructField("lam", T.DoubleType())])))
    return materialize(done, "pair_gradients").select(F.col("_g").alias(group), F.col("_y").alias(truth), F.col("_p").alias(pred), "lam")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which the group may be null."""
    other = right.select(*[F.col(k).alias(f"_r{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [left[k].eqNullSafe(other[f"_r{k}"]) for k in keys]
    return left.join(other, cond, how).drop(*[f"_r{k}" for k in keys])


def _around(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``sums`` with ``under_*`` and ``over_*``: the sums over the chunks before and after its own."""
    before = running_totals(sums, keys, "_b", names, prefix="under_")
    totals = sums.groupBy(*keys).agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    joined = null_safe(before, totals, keys)
    return joined.select(*keys, "_b", *[f"under_{n}" for n in names], *[(F.col(f"_t_{n}") - F.col(f"under_{n}") - F.col(n)).alias(f"over_{n}") for n in names])


def _with_far(curves: DataFrame, masses: DataFrame) -> DataFrame:
    """``curves`` with the masses in cells more than ``REACH`` above, where the curve is 1, in the chunks before and after.

    The cells above a bound are a few blocks of powers of two of cells; running sums over chunks are kept for each block, and a
    cell asks the blocks that make up its part. Where all predictions lie within reach there is nothing to ask.
    """
    span = masses.agg(F.min("_k").alias("low"), F.max("_k").alias("high")).first()
    none = [F.lit(0.0).alias(f"{side}_{n}") for side in ("under", "over") for n in ("fm", "fw")]
    if span["low"] is None or span["high"] - span["low"] <= REACH:
        return curves.select("*", *none)
    low, depth = span["low"], int(span["high"] - span["low"]).bit_length() + 1
    steps = F.sequence(F.lit(0), F.lit(depth - 1))

    def node(c: Column, level: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), level)).cast("long")

    held = (masses.select("_g", "_b", (F.col("_k") - low).alias("_c"), "fm", "fw", F.explode(steps).alias("_l"))
            .select("_g", "_b", "_l", node(F.col("_c"), F.col("_l")).alias("_n"), "fm", "fw"))
    start = F.col("_k") - low + REACH + 1
    asks = curves.select("_g", "_b", "_k", start.alias("_c"), F.explode(steps).alias("_l")).withColumn("_at", node(F.col("_c"), F.col("_l")))
    # [start, end) is the cell itself and, for every level at which start lies in an even block, the block after it.
    asks = asks.select("_g", "_b", "_k", "_l", F.explode(F.array_compact(F.array(
        F.when(F.col("_at") % 2 == 0, F.col("_at") + 1), F.when(F.col("_l") == 0, F.col("_at"))))).alias("_n"))
    marks = asks.select("_g", "_b", "_l", "_n").distinct().withColumn("fm", F.lit(0.0)).withColumn("fw", F.lit(0.0))
    sums = materialize(held.unionByName(marks).groupBy("_g", "_l", "_n", "_b").agg(*_sum_of(["fm", "fw"])), "far_sums")
    around = _around(sums, ["_g", "_l", "_n"], ["fm", "fw"])
    names = [f"{side}_{n}" for side in ("under", "over") for n in ("fm", "fw")]
    got = null_safe(asks, around, ["_g", "_l", "_n", "_b"]).groupBy("_g", "_b", "_k").agg(*_sum_of(names))
    return null_safe(curves, got, ["_g", "_b", "_k"])


def pair_weights(df: DataFrame, truth: str = "y", pred: str = "p", key: str = "id", group: str | None = None, sigma: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """``(key, weight)``: ``|gradient| + 1`` of every row, mean one, for continuous labels.

    Rows that take no part have a null weight; equal rows have equal weights; pairs are formed inside a group only.
    """
    if group is None:
        df, group = df.withColumn("_all", F.lit(0)), "_all"
    lam = pair_gradients(df, truth, pred, group, sigma, chunk).select(F.col(group).alias("_lg"), F.col(truth).alias("_ly"), F.col(pred).alias("_lp"), "lam")
    rows = df.select(key, F.col(group).alias("_g"), F.col(truth).cast("double").alias("_y"), F.col(pred).cast("double").alias("_p"))
    joined = rows.join(lam, F.col("_g").eqNullSafe(F.col("_lg")) & (F.col("_y") == F.col("_ly")) & (F.col("_p") == F.col("_lp")), "left")
    raw = joined.select(key, (F.abs("lam") + 1.0).alias("raw"))
    return raw.select(key, (F.col("raw") / raw.agg(F.avg("raw")).scalar()).alias("weight"))
