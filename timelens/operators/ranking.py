"""Ranking and regression metrics, fairness audit, pair weights and attributions."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISPARITY_LIMIT, SUBGROUPS
from ..functions.skew import first_n_per_key, in_order, ranked, running_totals, skewed_join


def errors(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """RMSE and MAE."""
    d = F.col(truth) - F.col(pred)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Average rank of each distinct value, ties sharing the middle of their span."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    below = running_totals(counts, [], value, ["n"])
    return below.select(value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(f"rank_{value}"))


def spearman(df: DataFrame, a: str = "y", b: str = "p") -> DataFrame:
    """Correlation of average ranks.

    Rows are first reduced to counts of distinct (a, b) pairs, so a value shared by a third
    of the rows meets its rank in few rows; the correlation is then a weighted one.
    """
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("w"))
    ra, rb = average_ranks(df, a), average_ranks(df, b)
    r = skewed_join(skewed_join(pairs, ra, [a]), rb, [b]).select("w", F.col(f"rank_{a}").alias("x"), F.col(f"rank_{b}").alias("z"))
    w, x, z = F.col("w"), F.col("x"), F.col("z")
    mid = (df.agg(F.count(F.lit(1))).scalar() + 1) / 2.0
    dx, dz = x - mid, z - mid
    s = r.agg(F.sum(w * dx * dz).alias("xz"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dz * dz).alias("zz"))
    base = F.sqrt(F.col("xx") * F.col("zz"))
    return s.select(F.when(base > 0, F.col("xz") / base).alias("spearman"))


def _dcg(df: DataFrame, keys: list[str], order: list[Column], gain: str, k: int, name: str) -> DataFrame:
    """Discounted gain of the first ``k`` rows per key; map tasks keep their best ``k`` only."""
    top = first_n_per_key(df, keys, order, k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (top.withColumn("_pos", F.row_number().over(w)).groupBy(*keys)
            .agg(F.sum((F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col("_pos") + 1.0)).alias(name)))


def ndcg(df: DataFrame, truth: str = "y", pred: str = "p", group: str | None = None, k: int = 5, tie: str = "id") -> DataFrame:
    """Mean NDCG@k over groups of two rows or more; a group without gain scores 1.

    Without a group the whole table is one group and only its best ``k`` rows are sorted.
    """
    if group is None:
        df, group = df.withColumn("_all", F.lit(0)), "_all"
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    if group != "_all":
        sizes = sizes.filter("n >= 2")
    dcg = _dcg(df, [group], [F.desc(pred), F.col(tie)], truth, k, "dcg")
    ideal = _dcg(df, [group], [F.desc(truth), F.col(tie)], truth, k, "idcg")
    per = sizes.join(dcg, group).join(ideal, group).withColumn(
        "ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(1.0))
    return per.agg(F.coalesce(F.avg("ndcg"), F.lit(1.0)).alias("ndcg"))


def subgroup_rules() -> dict[str, dict[str, Column]]:
    """Named subgroup predicates over the interaction columns."""
    col = {"insurance": "insurance_given", "age_group": "age_group", "urgency": "urgency_given"}
    return {g: {n: F.coalesce(F.col(col[g]).isin(vals), F.lit(False)) for n, vals in subs.items()} for g, subs in SUBGROUPS.items()}


def fairness(df: DataFrame, rules: dict[str, dict[str, Column]], truth: str = "y", pred: str = "p") -> DataFrame:
    """Count, errors, means and gap per subgroup from one pass of conditional sums."""
    d = F.col(truth) - F.col(pred)
    aggs, pieces = [], []
    for g, subs in rules.items():
        for n, cond in subs.items():
            k = f"{g}__{n}"
            aggs += [F.count(F.when(cond, 1)).alias(f"{k}__n"), F.sqrt(F.avg(F.when(cond, d * d))).alias(f"{k}__r"),
                     F.avg(F.when(cond, F.abs(d))).alias(f"{k}__a"), F.avg(F.when(cond, F.col(pred))).alias(f"{k}__p"),
                     F.avg(F.when(cond, F.col(truth))).alias(f"{k}__t")]
            pieces.append(f"'{g}', '{n}', `{k}__n`, `{k}__r`, `{k}__a`, `{k}__p`, `{k}__t`")
    long = df.agg(*aggs).select(F.expr(f"stack({len(pieces)}, {', '.join(pieces)}) as (`group`, subgroup, n, rmse, mae, mean_pred, mean_true)"))
    ok = F.col("n") >= 2
    return long.select("group", "subgroup", "n", F.when(ok, F.round("rmse", 5)).alias("rmse"), F.when(ok, F.round("mae", 5)).alias("mae"),
                       F.when(ok, F.round("mean_pred", 4)).alias("mean_pred"), F.when(ok, F.round("mean_true", 4)).alias("mean_true"),
                       F.when(ok, F.round(F.col("mean_pred") - F.col("mean_true"), 4)).alias("gap"))


def disparity(audit: DataFrame, limit: float = DISPARITY_LIMIT) -> DataFrame:
    """Largest difference of mean predictions inside each group, flagged above the limit."""
    spread = F.round(F.max("mean_pred") - F.min("mean_pred"), 4)
    return (audit.groupBy("group")
            .agg(F.when(F.count("mean_pred") >= 2, spread).otherwise(0.0).alias("max_disparity"))
            .withColumn("flagged", F.col("max_disparity") > limit))


def profile(df: DataFrame, kind: str, score: str, rating: str) -> DataFrame:
    """Counts and percent by type with score and rating ranges, next to overall rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
                                F.avg(score).alias("score_mean"), F.min(rating).alias("rating_min"),
                                F.max(rating).alias("rating_max"), F.avg(rating).alias("rating_mean"))
            .withColumn("percent", 100.0 * F.col("n") / total).withColumn(kind, F.coalesce(kind, F.lit("all"))))


def ordered_fingerprint(df: DataFrame, order: str, value: str, block: int = 1000, levels: int = 3) -> DataFrame:
    """First 8 hex digits of a digest of the values in order.

    A tree of digests: rows are numbered slice by slice, every ``block`` of them in a row make one digest, every ``block``
    digests the next, so no task or row holds more than a block. Three levels cover ``block ** 3`` rows.
    """
    rows = ranked(df.select(order, F.col(value).cast("string").alias("_v")), [], order, "_v", "_n").select((F.col("_n") - 1).alias("_n"), "_v")
    for _ in range(levels):
        seq = F.array_sort(F.collect_list(F.struct("_n", "_v")))
        rows = rows.groupBy(F.floor(F.col("_n") / block).alias("_b")).agg(F.md5(F.array_join(F.transform(seq, lambda s: s["_v"]), ", ")).alias("_v"))
        rows = rows.withColumnRenamed("_b", "_n")
    return rows.select(F.substring("_v", 1, 8).alias("fingerprint"))


def list_hash(df: DataFrame, order: str, value: str, digits: int = 8) -> DataFrame:
    """First hex digits of the MD5 of the JSON list of the numbers in order, as a training log states it.

    That digest is one sequence by definition and cannot be joined from parts: rows are put in order by all tasks, then one
    task streams them through the digest with the memory of a batch. For tables too long for that, ``ordered_fingerprint``
    and ``fingerprint`` spread the work. A null is written ``null``; no rows are the list ``[]``.
    """
    def stream(batches):
        state, gap = hashlib.md5(b"["), ""
        for pdf in batches:
            for v in pdf["_v"]:
                state.update((gap + (json.dumps(v) if v == v and v is not None else "null")).encode())
                gap = ", "
        state.update(b"]")
        yield pd.DataFrame({"data_hash": [state.hexdigest()[:digits]], "_some": [gap != ""]})

    placed = in_order(df.select(F.col(order).alias("_k"), F.col(value).cast("double").alias("_v")), ["_k", "_v"])
    hashed = (placed.repartition(1).sortWithinPartitions("_slice", "_at").select("_v")
              .mapInPandas(stream, "data_hash string, _some boolean"))
    none = df.sparkSession.range(1).select(F.lit(hashlib.md5(b"[]").hexdigest()[:digits]).alias("data_hash"), F.lit(False).alias("_some"))
    # A table without rows may have no task at all, so the digest of the empty list stands by.
    return hashed.unionByName(none).agg(F.coalesce(F.max(F.when(F.col("_some"), F.col("data_hash"))), F.max("data_hash")).alias("data_hash"))


def run_record(scored: DataFrame, model_type: str, features: int, rules: dict[str, dict[str, Column]] | None = None,
               truth: str = "y", pred: str = "p", key: str = "id", limit: float = DISPARITY_LIMIT) -> DataFrame:
    """The training-log row of one fitted model from its scored rows, without the number that the log gives it.

    Errors and rankings are rounded to five places; a group whose largest difference is above ``limit`` counts as a flag.
    """
    fit = errors(scored, truth, pred).first()
    audit = fairness(scored, subgroup_rules() if rules is None else rules, truth, pred)
    flags = disparity(audit, limit).agg(F.count_if("flagged")).scalar()
    return scored.agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("trained_at"), F.lit(model_type).alias("model_type"),
        F.count(F.lit(1)).alias("samples"), F.lit(features).cast("long").alias("features"),
        F.round(F.lit(fit["rmse"]).cast("double"), 5).alias("rmse"), F.round(F.lit(fit["mae"]).cast("double"), 5).alias("mae"),
        F.round(F.lit(spearman(scored, truth, pred).first()[0]).cast("double"), 5).alias("spearman"),
        F.round(F.lit(ndcg(scored, truth, pred, tie=key).first()[0]).cast("double"), 5).alias("ndcg5"),
        F.lit(list_hash(scored, key, truth).first()[0]).alias("data_hash"), flags.cast("long").alias("fairness_flags"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint at any scale: row count and sum of 60-bit row digests, in which equal rows do not cancel."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), 1, 15), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


#: Nodes a cell of predictions has, and cells beyond which a logistic curve is 0 or 1 to the last bit of a double.
NODES, REACH = 16, 40


def pair_weights(df: DataFrame, truth: str = "y", pred: str = "p", key: str = "id", group: str | None = None,
                 sigma: float = 1.0) -> DataFrame:
    """Ranking weight per row from all pairs with ``y_i > y_j``: ``|gradient sum| + 1``, mean one.

    No pair is ever formed. For one opponent label the gradient sum is a smooth function of a row's own prediction.
    Predictions are cut into cells of width ``1 / sigma``; the function is summed exactly at the Chebyshev nodes of every
    cell that holds rows and read off inside the cell by barycentric interpolation, whose error is below 1e-15. Opponents
    within ``REACH`` cells are summed one by one, those beyond add 0 or 1 each and come as running totals over cells. Work
    is linear in the distinct predictions whatever their range. Labels are combined by running sums over the distinct
    labels of a node.
    """
    if group is None:
        df, group = df.withColumn("_all", F.lit(0)), "_all"
    angles = [math.pi * (j + 0.5) / NODES for j in range(NODES)]
    y, p, width = F.col(truth), F.col(pred), 2 * REACH + 1
    rows = df.withColumn("_k", F.floor(p * sigma).cast("long"))
    cells = rows.where(F.col("_k").isNotNull()).groupBy(group, truth, pred, "_k").agg(F.count(F.lit(1)).cast("double").alias("c"))
    totals = cells.groupBy(group, truth, "_k").agg(F.sum("c").alias("c"))
    targets = totals.select(group, "_k").distinct()
    labels = totals.groupBy(group, truth).agg(F.sum("c").alias("m"))

    blocks = targets.groupBy(group, F.floor(F.col("_k") / width).alias("_b")).agg(F.collect_list("_k").alias("_ks"))
    reached = F.array_distinct(F.array(F.floor((F.col("_k") - REACH) / width), F.floor((F.col("_k") + REACH) / width)))
    near = (cells.withColumn("_b", F.explode(reached)).join(blocks, [group, "_b"])
            .select(group, truth, pred, "c", F.explode(F.filter("_ks", lambda t: F.abs(t - F.col("_k")) <= REACH)).alias("_t")))
    at = F.array(*[(F.col("_t") + (0.5 + 0.5 * math.cos(a))) / sigma for a in angles])
    near = (near.select(group, truth, "_t", pred, "c", F.posexplode(at).alias("j", "x")).groupBy(group, truth, "_t", "j")
            .agg(F.sum(F.col("c") / (1.0 + F.exp(sigma * (F.col("x") - p)))).alias("near")))

    marks = (totals.select(group, truth, F.col("_k").alias("pos"), "c", F.lit(None).cast("long").alias("_t"))
             .unionByName(labels.join(targets, group).select(group, truth, (F.col("_k") + REACH).alias("pos"), F.lit(0.0).alias("c"), F.col("_k").alias("_t"))))
    beyond = Window.partitionBy(group, truth).orderBy("pos").rangeBetween(1, Window.unboundedFollowing)
    far = marks.withColumn("far", F.coalesce(F.sum("c").over(beyond), F.lit(0.0))).where("_t is not null")
    nodes = (far.join(labels, [group, truth]).select(group, truth, "_t", "far", "m", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("j"))
             .join(near, [group, truth, "_t", "j"], "left").withColumn("g", F.col("far") + F.coalesce("near", F.lit(0.0))))
    w = Window.partitionBy(group, "_t", "j").orderBy(truth)
    low, high = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    g, rest = F.col("g"), F.col("m") - F.col("g")

    def total(c, over):
        return F.coalesce(F.sum(c).over(over), F.lit(0.0))

    grad = (-(y * total(g, low) - total(y * g, low)) + (total(y * rest, high) - y * total(rest, high))) * sigma
    packed = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"])
    used = totals.select(group, truth, F.col("_k").alias("_t"))
    curves = (nodes.select(group, truth, "_t", "j", grad.alias("v")).join(used, [group, truth, "_t"], "left_semi")
              .groupBy(group, truth, "_t").agg(packed.alias("_v")).withColumnRenamed("_t", "_k"))
    where = F.array(*[F.lit(math.cos(a)) for a in angles])
    weight = F.array(*[F.lit((-1.0) ** j * math.sin(a)) for j, a in enumerate(angles)])
    joined = skewed_join(rows, curves, [group, truth, "_k"], "left").withColumn("_x", (p * sigma - F.col("_k")) * 2.0 - 1.0)
    terms = F.transform(F.arrays_zip(F.col("_v").alias("v"), where.alias("t"), weight.alias("w")), lambda z: F.struct(
        z["v"].alias("v"), F.when(F.col("_x") != z["t"], z["w"] / (F.col("_x") - z["t"])).alias("w")))
    joined = joined.withColumn("_s", terms)
    exact = F.try_element_at(F.filter("_s", lambda z: z["w"].isNull()), F.lit(1))["v"]
    fold = lambda f: F.aggregate(F.transform("_s", f), F.lit(0.0), lambda a, b: a + b)
    lam = F.coalesce(exact, fold(lambda z: z["w"] * z["v"]) / fold(lambda z: z["w"]))
    raw = joined.select(key, (F.abs(lam) + 1.0).alias("raw"))
    return raw.select(key, (F.col("raw") / raw.agg(F.avg("raw")).scalar()).alias("weight"))


def attributions(df: DataFrame, weights: dict[str, float], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Per-row contributions ``weight * (x - mean) / std`` of a linear model."""
    return df.select("*", *[(F.lit(w) * (F.col(c) - stats[c][0]) / (stats[c][1] or 1.0)).alias(f"attr_{c}") for c, w in weights.items()])


def attribution_summary(attributed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute contribution, rank by absolute weight, direction; one row per feature."""
    names = list(weights)
    means = attributed.agg(*[F.avg(F.abs(F.col(f"attr_{c}"))).alias(c) for c in names])
    pieces = ", ".join(f"'{c}', {weights[c]!r}D, `{c}`" for c in names)
    long = means.select(F.expr(f"stack({len(names)}, {pieces}) as (feature, weight, mean_abs)"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("weight")), "feature")
    return long.select("feature", F.round("weight", 5).alias("weight"), F.row_number().over(w).alias("place"),
                       F.when(F.col("weight") > 0, "positive").when(F.col("weight") < 0, "negative").otherwise("neutral").alias("direction"),
                       F.round(F.abs("weight"), 5).alias("abs_importance"), "mean_abs")


