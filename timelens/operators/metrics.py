"""Classification metrics in long form, always keyed by class name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.skew import null_safe_join, running_totals


def confusion(pred: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Counts by (keys, label, prediction): at most classes squared rows a key."""
    w = F.col(weight) if weight else F.lit(1)
    return pred.groupBy(*list(keys or []), "label", "prediction").agg(F.sum(w).alias("n"))


def per_class(pred: DataFrame, keys: list[str] | None = None, classes: list[str] = LABELS,
              weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, zero where a division has no base."""
    keys = list(keys or [])
    c = confusion(pred, keys, weight)
    aggs = []
    for name in classes:
        is_label, is_pred = F.col("label") == name, F.col("prediction") == name
        aggs += [F.sum(F.when(is_label & is_pred, F.col("n")).otherwise(0)).alias(f"tp_{name}"),
                 F.sum(F.when(is_label, F.col("n")).otherwise(0)).alias(f"sup_{name}"),
                 F.sum(F.when(is_pred, F.col("n")).otherwise(0)).alias(f"pre_{name}")]
    wide = c.groupBy(*keys).agg(*aggs)
    pieces = ", ".join(f"'{n}', tp_{n}, sup_{n}, pre_{n}" for n in classes)
    long = wide.select(*keys, F.expr(f"stack({len(classes)}, {pieces}) as (class, tp, support, predicted)"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (long.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .select(*keys, "class", "precision", "recall", "f1", "support"))


def averages(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted averages over classes seen in labels or predictions."""
    keys = list(keys or [])
    seen = per.filter((F.col("support") > 0) | (F.col("precision") > 0))
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return (seen.groupBy(*keys) if keys else seen.groupBy()).agg(*macro, *weighted)


def class_auc(scores: DataFrame, keys: list[str] | None = None, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """Exact one-vs-rest AUC per (keys, class) from ``(keys, label, class, score)``.

    Scores are reduced to positive and negative counts per distinct value, then each value
    needs only the negatives below it, which ``running_totals`` finds slice by slice. Tied
    values count one half. A class without positives or negatives has no AUC.
    """
    group = [*list(keys or []), "class"]
    w = F.col(weight) if weight else F.lit(1)
    hit = F.col("label") == F.col("class")
    counts = scores.groupBy(*group, "score").agg(
        F.sum(F.when(hit, w).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(hit, 0).otherwise(w)).cast("double").alias("neg"))
    below = running_totals(counts, group, "score", ["neg"], parts)
    sums = below.groupBy(*group).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    base = F.col("n_pos") * F.col("n_neg")
    return sums.select(*group, F.when(base > 0, F.col("u") / base).alias("auc"), "n_pos", "n_neg")


def macro_auc(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over classes that have an AUC."""
    keys = list(keys or [])
    return (per.groupBy(*keys) if keys else per.groupBy()).agg(F.avg("auc").alias("auc"))


def roc_points(scores: DataFrame, classes: list[str] = LABELS) -> DataFrame:
    """ROC points per class: rates over scores at or above each distinct score."""
    hit = (F.col("label") == F.col("class")).cast("long")
    counts = scores.filter(F.col("class").isin(classes)).groupBy("class", "score").agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    totals = counts.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    below = running_totals(counts, ["class"], "score", ["pos", "neg"])
    rows = below.join(totals, "class")
    return rows.select("class", "score", ((F.col("N") - F.col("before_neg")) / F.col("N")).alias("fpr"),
                       ((F.col("P") - F.col("before_pos")) / F.col("P")).alias("tpr"))


def macro_roc(points: DataFrame, grid: int = 200) -> DataFrame:
    """Macro curve: each class interpolated on an even grid of false-positive rates, then averaged.

    Each point is expanded to the grid cells between itself and the next, so a class is
    never held whole: neighbours come from per-cell ends (at most ``grid`` rows a class).
    """
    step = 1.0 / (grid - 1)
    start = points.select("class").distinct().select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = points.select("class", "fpr", "tpr").unionByName(start)
    # one vertical run per false-positive rate: its lowest and highest true-positive rate
    runs = pts.groupBy("class", "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    cell = F.least(F.floor(F.col("fpr") / step), F.lit(grid - 1)).cast("int")
    runs = runs.withColumn("cell", cell)
    ends = runs.groupBy("class", "cell").agg(F.min(F.struct("fpr", "lo", "hi")).alias("first"), F.max(F.struct("fpr", "lo", "hi")).alias("last"))
    w = Window.partitionBy("class").orderBy("cell")
    across = (ends.withColumn("nxt", F.lead("first").over(w))
              .select("class", F.col("last.fpr").alias("x0"), F.col("last.hi").alias("y0"),
                      F.col("nxt.fpr").alias("x1"), F.col("nxt.lo").alias("y1")))
    wi = Window.partitionBy("class", "cell").orderBy("fpr")
    inside = (runs.withColumn("x1", F.lead("fpr").over(wi)).withColumn("y1", F.lead("lo").over(wi))
              .filter(F.col("x1").isNotNull()).select("class", F.col("fpr").alias("x0"), F.col("hi").alias("y0"), "x1", "y1"))
    segs = across.unionByName(inside)
    first_g = F.ceil(F.col("x0") / step - 1e-9).cast("int")
    last_g = F.coalesce(F.ceil(F.col("x1") / step - 1e-9).cast("int") - 1, F.lit(grid - 1))
    spread = segs.withColumn("g", F.explode(F.when(last_g >= first_g, F.sequence(first_g, last_g))))
    x = F.col("g") * F.lit(step)
    y = F.when(F.col("x1").isNull() | (x <= F.col("x0")), F.col("y0")).otherwise(
        F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return spread.select("class", "g", y.alias("tpr")).groupBy("g").agg(F.avg("tpr").alias("tpr")).select(
        F.col("g").alias("point"), (F.col("g") * F.lit(step)).alias("fpr"), "tpr")


def long_metrics(per: DataFrame, auc: DataFrame, avg: DataFrame, mauc: DataFrame, ids: dict[str, str]) -> DataFrame:
    """Everything as ``(experiment, dataset, model, scope, class, metric, value)`` rows."""
    tags = [F.lit(ids[k]).alias(k) for k in ("experiment", "dataset", "model")]
    pc = null_safe_join(per, auc.select("class", "auc"), ["class"], "left")
    one = pc.select("class", F.expr("stack(5, 'precision', precision, 'recall', recall, 'f1', f1, 'roc_auc', auc, "
                                    "'support', cast(support as double)) as (metric, value)"))
    one = one.select(*tags, F.lit("class").alias("scope"), "class", "metric", "value")
    two = avg.select(F.expr("stack(6, 'macro', 'precision', macro_precision, 'macro', 'recall', macro_recall, 'macro', 'f1', macro_f1, "
                            "'weighted', 'precision', weighted_precision, 'weighted', 'recall', weighted_recall, "
                            "'weighted', 'f1', weighted_f1) as (scope, metric, value)"))
    two = two.select(*tags, "scope", F.lit(None).cast("string").alias("class"), "metric", "value")
    three = mauc.select(*tags, F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("class"),
                        F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    return one.unionByName(two).unionByName(three)


def evaluate(pred: DataFrame, scores: DataFrame, ids: dict[str, str]) -> DataFrame:
    per, auc = per_class(pred), class_auc(scores)
    return long_metrics(per, auc, averages(per), macro_auc(auc), ids)


def sensitivity(metrics: DataFrame, base: str = "full", other: str = "high_conf") -> DataFrame:
    """Metric of the reduced dataset minus the full one, per model and class."""
    m = metrics.filter((F.col("scope") == "class") & F.col("metric").isin("f1", "roc_auc"))
    key = ["experiment", "model", "class", "metric"]
    a = m.filter(F.col("dataset") == other).select(*key, F.col("value").alias("v_other"))
    b = m.filter(F.col("dataset") == base).select(*key, F.col("value").alias("v_base"))
    return a.join(b, key).select(*key, (F.col("v_other") - F.col("v_base")).alias("delta"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Macro AUC and F1 per experiment, dataset and model, ranked by AUC; F1 may be missing.

    The metrics table has a few rows per experiment, so one ordered pass ranks it.
    """
    m = metrics.filter(F.col("scope") == "macro").groupBy("experiment", "dataset", "model").agg(
        F.max(F.when(F.col("metric") == "roc_auc", F.col("value"))).alias("auc"),
        F.max(F.when(F.col("metric") == "f1", F.col("value"))).alias("f1"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("auc"), "experiment", "dataset", "model")
    return m.withColumn("place", F.row_number().over(w))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Macro AUC of two metric tables side by side with the difference."""
    def macro(df, name):
        return (df.filter((F.col("scope") == "macro") & (F.col("metric") == "roc_auc"))
                .select("experiment", "dataset", "model", F.col("value").alias(name)))
    return (macro(old, "old_auc").join(macro(new, "new_auc"), ["experiment", "dataset", "model"])
            .withColumn("delta", F.col("new_auc") - F.col("old_auc")))


def fold_auc_summary(scores: DataFrame, config: list[str]) -> DataFrame:
    """Mean and sample deviation of the macro AUC over folds, per configuration and model."""
    per_fold = macro_auc(class_auc(scores, [*config, "fold"]), [*config, "fold"])
    return per_fold.groupBy(*config).agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"),
                                         F.count("auc").alias("folds"))


def best_model(summary: DataFrame, config: str, model: str = "model") -> DataFrame:
    """Model with the highest mean per configuration; ties go to the first name."""
    order = F.struct(F.negative("mean_auc").alias("m"), F.col(model))
    return (summary.filter(F.col("mean_auc").isNotNull()).groupBy(config)
            .agg(F.min(order).alias("top")).select(config, F.col(f"top.{model}").alias("best"),
                                                   F.negative("top.m").alias("mean_auc")))


def seed_summary(aucs: DataFrame, config: list[str], value: str = "auc") -> DataFrame:
    return aucs.groupBy(*config).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                     F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def blend(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Average probability over models per row and class."""
    return probabilities.groupBy(*keys, "class").agg(F.avg("proba").alias("proba"))


def class_weights(users: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: one row per class."""
    counts = users.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n, k = counts.agg(F.sum("n_c")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, (n / (k * F.col("n_c"))).alias("weight"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column in one pass, as long rows."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    pieces = ", ".join(f"'{c}', `m_{c}`, `s_{c}`, `n_{c}`" for c in columns)
    return df.agg(*aggs).select(F.expr(f"stack({len(columns)}, {pieces}) as (feature, mean, std, n)"))


def calibration(df: DataFrame, deviation: str) -> DataFrame:
    """Mean and population deviation of the predictive deviations."""
    return df.agg(F.avg(deviation).alias("mean_std"), F.stddev_pop(deviation).alias("std_of_std"))


def argmax_class(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Class with the highest score per row; ties go to the first class name."""
    order = F.struct(F.negative("score").alias("s"), F.col("class"))
    return (scores.groupBy(*keys, "label").agg(F.min(order).alias("top"))
            .select(*keys, "label", F.col("top.class").alias("prediction")))

