"""Bayesian ridge from one distributed pass, with predictive deviation as a column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FOLDS, SEED
from ..functions.skew import seeded_order, ranked
from ..operators import ranking
from ..operators.quantiles import exact_quantiles
from ..session import materialize


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Weighted products ``(i, j, value)`` of the columns and a leading constant.

    Each task adds up its Arrow batches into one small matrix and emits its upper triangle,
    so the shuffle carries a few hundred rows a task whatever the row count.
    """
    k = len(columns) + 1
    iu, ju = np.triu_indices(k)

    def partial(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(dtype=float)])
            w = pdf["_w"].to_numpy(dtype=float)
            total += (x * w[:, None]).T @ x
        yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "value": total[iu, ju]})

    ready = df.select(*[F.col(c).cast("double").alias(c) for c in columns], (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    return ready.mapInPandas(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """The same as an array: (columns + 1) squared numbers on the driver."""
    k = len(columns) + 1
    out = np.zeros((k, k))
    for r in gram(df, columns, weight).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair as ``(a, b, r)``; columns are centred first."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    live = [c for c in columns if stats[f"s_{c}"]]
    scaled = df.select(*[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in live])
    names = F.array(*[F.lit(c) for c in live])
    g = gram(scaled, live)
    n = df.agg(F.count(F.lit(1))).scalar()
    return g.filter((F.col("i") > 0) & (F.col("j") > F.col("i"))).select(
        F.element_at(names, F.col("i")).alias("a"), F.element_at(names, F.col("j")).alias("b"), (F.col("value") / n).alias("r"))


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values replaced by the column median, exact for all columns in the same passes."""
    q = exact_quantiles(df, columns, [0.5])
    return df.select(*[c for c in df.columns if c not in columns],
                     *[F.coalesce(F.col(c), F.lit(q[c][0]).cast("double")).alias(c) for c in columns])


def drop_redundant(df: DataFrame, columns: list[str], min_variance: float = 1e-6, max_r: float = 0.95) -> list[str]:
    """Columns that vary and are not a near copy of a more variable one."""
    filled = median_filled(df, [c for c in columns])
    row = filled.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    raw = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if row[c] is not None and row[c] > min_variance]
    high = {(r["a"], r["b"]) for r in correlations(filled, kept).filter(F.abs("r") > max_r).collect()}
    dropped: set[str] = set()
    for j, col in enumerate(kept):
        for other in kept[:j]:
            if (other, col) in high:
                dropped.add(other if (raw[col] or 0.0) >= (raw[other] or 0.0) else col)
    return [c for c in kept if c not in dropped]


@dataclass
class Ridge:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float
    lam: float
    sigma: np.ndarray
    center: np.ndarray

    def _scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.scale)]

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for x, w in zip(self._scaled(), self.coef):
            out = out + x * float(w)
        return out

    def deviation(self) -> Column:
        """``sqrt(1/alpha + x' S x)`` through a factor of S, as one product a batch; null where a feature is.

        As in the estimator being matched, the scaled row is not centred again.
        """
        values, vectors = np.linalg.eigh(self.sigma)
        root = vectors * np.sqrt(np.maximum(values, 0.0))
        root = root[:, np.any(root, axis=0)]
        mean, scale, noise = np.array(self.mean, float), np.array(self.scale, float), 1.0 / self.alpha

        @F.arrow_udf("double")
        def spread(*columns: pa.Array) -> pa.Array:
            # A null becomes NaN here and null again below.
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
            part = ((x - mean) / scale) @ root
            missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
            return pa.array(np.sqrt(noise + (part * part).sum(1)), pa.float64(), mask=missing)

        return spread(*[F.col(c).cast("double") for c in self.features])


def fit_ridge(df: DataFrame, features: list[str], target: str = "y", weight: str | None = None, max_iter: int = 500, tol: float = 1e-3,
              prior: float = 1e-6) -> Ridge:
    """Evidence maximisation on sufficient statistics.

    One unweighted pass gives the scaling, one (weighted) pass the moments; when no weights are
    given both come from the same pass. The iteration touches only feature-sized matrices.
    """
    cols = [*features, target]
    plain = gram_matrix(df, cols)
    n = plain[0, 0]
    mean = plain[0, 1:-1] / n
    var = np.maximum(np.diag(plain)[1:-1] / n - mean**2, 0.0)
    scale = np.where(var > 1e-14, np.sqrt(var), 1.0)
    g = gram_matrix(df, cols, weight) if weight else plain
    sw = g[0, 0]
    k = len(features)
    d = np.concatenate([mean, [0.0]])
    s = np.concatenate([scale, [1.0]])
    raw = g[1:, 1:] - np.outer(d, g[0, 1:]) - np.outer(g[1:, 0], d) + sw * np.outer(d, d)
    first = (g[0, 1:] - sw * d) / s
    moments = raw / np.outer(s, s)
    center = first / sw
    cen = moments - sw * np.outer(center, center)
    xx, xy, yy = cen[:k, :k], cen[:k, k], cen[k, k]
    y_var = plain[-1, -1] / n - (plain[0, -1] / n) ** 2
    alpha, lam = 1.0 / (y_var + np.finfo(float).eps), 1.0
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    proj = vectors.T @ xy

    def solve(a, b):
        w = vectors @ (proj / (values + b / a))
        return w, max(yy - 2 * w @ xy + w @ xx @ w, 0.0)

    old = None
    for _ in range(max_iter):
        coef, rss = solve(alpha, lam)
        gamma = np.sum(alpha * values / (lam + alpha * values))
        lam = (gamma + 2 * prior) / (coef @ coef + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if old is not None and np.sum(np.abs(old - coef)) < tol:
            break
        old = coef
    coef, _ = solve(alpha, lam)
    sigma = (vectors / (alpha * values + lam)) @ vectors.T
    return Ridge(features, mean, scale, coef, float(center[k] - center[:k] @ coef), float(alpha), float(lam), sigma, center[:k])


def fit_ranked(df: DataFrame, features: list[str], key: str = "id") -> tuple[Ridge, str]:
    """Plain fit, then a refit weighted by ranking gradients; the better NDCG@5 wins, ties to the refit."""
    base = fit_ridge(df, features)
    scored = df.withColumn("p", base.predict())
    weights = ranking.pair_weights(scored.select(key, "y", "p"), key=key)
    refit_in = materialize(scored.drop("p").join(weights, key), "weighted")
    refit = fit_ridge(refit_in, features, weight="weight")

    def ndcg(m):
        return ranking.ndcg(df.select(key, "y", m.predict().alias("p")), tie=key).first()["ndcg"]

    return (refit, "reweighted") if ndcg(refit) >= ndcg(base) else (base, "plain")


def cross_validate(df: DataFrame, features: list[str], key: str = "id", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """RMSE, NDCG@5 and Spearman per fold; needs ten rows, an undefined Spearman counts as zero."""
    spark = df.sparkSession
    schema = "fold int, rmse double, ndcg5 double, spearman double"
    n = df.limit(10).count()
    if n < 10:
        return spark.createDataFrame([], schema)
    order = ranked(df.select(key).withColumn("_h", seeded_order(key, seed)), [], "_h", key, "_r")
    dealt = materialize(df.join(order.select(key, F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int").alias("fold")), key), "folds")
    rows = []
    for k in range(folds):
        m = fit_ridge(dealt.filter(F.col("fold") != k), features)
        test = dealt.filter(F.col("fold") == k).select(key, "y", m.predict().alias("p"))
        rows.append((k, ranking.errors(test).first()["rmse"], ranking.ndcg(test, tie=key).first()["ndcg"],
                     ranking.spearman(test).first()["spearman"] or 0.0))
    return spark.createDataFrame(rows, schema)
