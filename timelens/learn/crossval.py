"""Out-of-fold predictions, stacking, searches, importance, permutation test and experiments."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FOLDS, SEED
from ..functions.skew import ranked, seeded_order
from ..operators import clean, matrix, metrics
from ..session import materialize
from .folds import CLASSES, assign_folds
from .models import Fit, resolve


def with_folds(data: DataFrame, seed: int = SEED, folds: int = FOLDS, key: str = "author") -> DataFrame:
    """Rows with their folds, written once: models read their input many times."""
    return materialize(data.join(assign_folds(data, key, "label", seed, folds), key), "folded")


def out_of_fold(data: DataFrame, features: list[str], fit: Fit, seed: int = SEED, folds: int = FOLDS, key: str = "author") -> DataFrame:
    """Long ``(key, label, fold, class, score)``; every row is scored by a model that has not seen it.

    ``data`` may have its folds already (``with_folds``), which callers that fit many models on the same rows make use of.
    The folds are independent Spark jobs and are submitted together.
    """
    folded = data if "fold" in data.columns else with_folds(data, seed, folds, key)

    @inheritable_thread_target(data.sparkSession)
    def one(k: int) -> DataFrame:
        score = fit(folded.filter(F.col("fold") != k), features)
        return score(folded.filter(F.col("fold") == k), [key, "label", "fold"])

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(one, range(folds)))
    proba = reduce(lambda a, b: a.unionByName(b), parts)
    names = F.array(*[F.lit(c) for c in CLASSES])
    return (proba.select(key, "label", "fold", F.posexplode("proba").alias("i", "score"))
            .select(key, "label", "fold", F.element_at(names, F.col("i") + 1).alias("class"), "score"))


def oof_auc(data: DataFrame, features: list[str], fit: Fit, seed: int = SEED, folds: int = FOLDS, key: str = "author") -> float | None:
    scores = out_of_fold(data, features, fit, seed, folds, key)
    return metrics.macro_auc(metrics.class_auc(scores)).first()["auc"]


def stack(oofs: dict[str, DataFrame], meta: Fit, seed: int = SEED, folds: int = FOLDS, key: str = "author") -> DataFrame:
    """Base probabilities as features of a meta model that is itself cross-validated."""
    wide = None
    for name, scores in oofs.items():
        cols = scores.groupBy(key, "label").pivot("class", CLASSES).agg(F.first("score"))
        cols = cols.select(key, *(["label"] if wide is None else []), *[F.col(c).alias(f"{name}_{c}") for c in CLASSES])
        wide = cols if wide is None else wide.join(cols, key)
    wide = materialize(wide, "stack")
    return out_of_fold(wide, [f"{n}_{c}" for n in oofs for c in CLASSES], meta, seed, folds, key)


def search(data: DataFrame, features: list[str], candidates: list[dict], make: Callable[..., Fit], seed: int = SEED,
           folds: int = FOLDS) -> DataFrame:
    """AUC of every parameter set, best first; the earlier set wins a tie."""
    data = with_folds(data, seed, folds)
    rows = [(i, str(p), oof_auc(data, features, make(**p), seed, folds)) for i, p in enumerate(candidates)]
    df = data.sparkSession.createDataFrame(rows, "trial int, params string, auc double")
    return df.orderBy(F.desc_nulls_last("auc"), "trial")


def grid(**axes: list) -> list[dict]:
    """All combinations in order."""
    out = [{}]
    for name, values in axes.items():
        out = [{**p, name: v} for p in out for v in values]
    return out


def random_space(trials: int, seed: int = SEED, **ranges: tuple) -> list[dict]:
    """Reproducible draws; a range is ``(lo, hi, kind)`` with kind int, float or log."""
    import hashlib
    out = []
    for t in range(trials):
        p = {}
        for name, (lo, hi, kind) in ranges.items():
            u = int(hashlib.md5(f"{t}:{name}:{seed}".encode()).hexdigest()[:8], 16) / 2**32
            p[name] = (lo * (hi / lo) ** u if kind == "log" else lo + (hi - lo) * u if kind == "float" else int(lo + (hi - lo + 1) * u))
        out.append(p)
    return out


def importance(data: DataFrame, features: list[str], fit: Fit, top: int = 15) -> DataFrame:
    """Impurity importance of a forest fitted on all rows, largest first."""
    score = fit(data, features)
    rows = [(c, float(v)) for c, v in zip(score.prep.features, score.model.featureImportances.toArray())]
    df = data.sparkSession.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def permuted_labels(data: DataFrame, seed: int, key: str = "author") -> DataFrame:
    """Labels dealt to rows in another hashed order: two ranks joined by position."""
    base = data.select(key, "label").withColumn("_a", seeded_order(key, f"a{seed}")).withColumn("_b", seeded_order(key, f"b{seed}"))
    left = ranked(base.select(key, "_a"), [], "_a", key, "_pos")
    right = ranked(base.select(key, "label", "_b"), [], "_b", key, "_pos").select("_pos", "label")
    return data.drop("label").join(left.select(key, "_pos").join(right, "_pos").drop("_pos"), key)


def permutation_test(data: DataFrame, features: list[str], fit: Fit, permutations: int, seed: int = SEED, folds: int = FOLDS) -> DataFrame:
    """Null AUCs from refits on permuted labels; ``p = (1 + #>=observed) / (1 + P)``."""
    spark = data.sparkSession
    observed = oof_auc(data, features, fit, seed, folds)
    nulls = []
    for i in range(permutations):
        shuffled = materialize(permuted_labels(data, seed + i), "permuted")
        nulls.append((i, oof_auc(shuffled, features, fit, seed, folds)))
    df = spark.createDataFrame(nulls, "i int, auc double").filter("auc is not null")
    return df.agg(F.lit(observed).alias("observed"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_std"),
                  ((1 + F.count(F.when(F.col("auc") >= observed, 1))) / (1 + F.count("auc"))).alias("p_value"))


def run_experiment(spark: SparkSession, name: str, table: DataFrame, models: list[str], family: str = "all", seed: int = SEED,
                   folds: int = FOLDS, **overrides: dict) -> DataFrame:
    """Metrics of every model on the full and the high-confidence users, as long rows."""
    out = []
    ready = matrix.presence_flags(table)
    features = matrix.select_family(ready, family)
    for dataset, users in (("full", ready), ("high_conf", clean.high_confidence(ready))):
        users = materialize(users, "users")
        for model, fit in resolve(models, **overrides).items():
            scores = materialize(out_of_fold(users, features, fit, seed, folds), "oof")
            pred = metrics.argmax_class(scores, ["author"])
            out.append(metrics.evaluate(pred, scores, {"experiment": name, "dataset": dataset, "model": model}))
    return reduce(lambda a, b: a.unionByName(b), out)


