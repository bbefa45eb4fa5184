"""Metrics, resampling and models against plain Python on small random inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.learn import crossval, folds, models, resample, ridge
from timelens.operators import metrics, ranking
from timelens.sources import tables


def auc(pos, neg):
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


@pytest.mark.parametrize("parts", [2, 7, 32])
def test_auc_with_ties(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, "crisis" if rng.random() < 0.3 else "neither", "crisis", float(rng.integers(0, 9)) / 9) for i in range(120)]
    got = metrics.class_auc(spark.createDataFrame(rows, "id int, label string, class string, score double"), parts=parts).first()
    assert got["auc"] == pytest.approx(auc([r[3] for r in rows if r[1] == "crisis"], [r[3] for r in rows if r[1] != "crisis"]))


def test_auc_edge_cases(spark):
    rows = [(0, "crisis", "crisis", 0.5), (1, "neither", "crisis", 0.5), (2, "neither", "recovery", 0.1)]
    got = {r["class"]: r["auc"] for r in metrics.class_auc(spark.createDataFrame(rows, "id int, label string, class string, score double")).collect()}
    assert got == {"crisis": 0.5, "recovery": None}


def test_ndcg(spark):
    df = spark.createDataFrame([(i, 0.0, float(i)) for i in range(4)], "id int, y double, p double")
    assert ranking.ndcg(df).first()[0] == 1.0
    rows = [(0, 1.0, 0.1), (1, 0.0, 0.9), (2, 0.5, 0.5)]
    gain = lambda ys: sum((2**y - 1) / np.log2(k + 2) for k, y in enumerate(ys))
    got = ranking.ndcg(spark.createDataFrame(rows, "id int, y double, p double")).first()[0]
    assert got == pytest.approx(gain([0, 0.5, 1]) / gain([1, 0.5, 0]))


@pytest.mark.parametrize("spread", [0.1, 1.0, 8.0, 1000.0])
def test_pair_weights_match_all_pairs(spark, spread):
    rng = np.random.default_rng(1)
    y, p = rng.choice([0.0, 0.25, 0.6, 1.0], 80), rng.normal(0, spread, 80)
    p[:6] = [0.0, 1.0, 0.5, -1.0, 2.0, 2.0]
    lam = np.zeros(80)
    for i in range(80):
        for j in range(80):
            if y[i] > y[j]:
                g = -abs(y[i] - y[j]) / (1 + np.exp(min(700.0, p[i] - p[j])))
                lam[i] += g
                lam[j] -= g
    want = np.abs(lam) + 1
    want /= want.mean()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y double, p double")
    got = {r["id"]: r["weight"] for r in ranking.pair_weights(df).collect()}
    assert np.allclose([got[i] for i in range(80)], want, atol=1e-9)


def test_fairness_small_group(spark):
    rows = [(1.0, 0.5, "child"), (0.0, 0.5, "adult"), (1.0, 1.0, "adult")]
    df = spark.createDataFrame(rows, "y double, p double, g string")
    audit = ranking.fairness(df, {"age": {n: F.col("g") == n for n in ("child", "adult")}})
    got = {r["subgroup"]: r for r in audit.collect()}
    assert got["child"]["n"] == 1 and got["child"]["rmse"] is None and got["adult"]["gap"] == 0.25
    assert ranking.disparity(audit).first()["max_disparity"] == 0.0


def test_per_class_without_predictions(spark):
    df = spark.createDataFrame([("crisis", "neither"), ("neither", "neither")], "label string, prediction string")
    got = {r["class"]: r for r in metrics.per_class(df).collect()}
    assert got["crisis"]["precision"] == 0 and got["neither"]["precision"] == 0.5 and got["recovery"]["support"] == 0
    assert metrics.averages(metrics.per_class(df)).first()["macro_f1"] == pytest.approx((0 + 2 / 3) / 2)


def users(spark, n=90):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        label = ["crisis", "neither", "recovery"][i % 3] if i % 5 else "neither"
        x = {"crisis": 2.0, "neither": 0.0, "recovery": -2.0}[label] + rng.normal()
        rows.append((f"u{i}", label, float(x), float(rng.normal()) if i % 7 else None, None))
    return spark.createDataFrame(rows, "author string, label string, a double, b double, gone double")


def test_folds_are_balanced(spark):
    u = users(spark)
    f = u.join(folds.assign_folds(u), "author").groupBy("label", "fold").count().collect()
    for label in ("crisis", "neither", "recovery"):
        sizes = [r["count"] for r in f if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_out_of_fold_covers_rows_once(spark):
    u = users(spark)
    s = crossval.out_of_fold(u, ["a", "b", "gone"], models.logistic(), folds=3)
    rows = s.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("p")).collect()
    assert len(rows) == 90 and all(r["n"] == 3 and abs(r["p"] - 1) < 1e-9 for r in rows)
    assert metrics.macro_auc(metrics.class_auc(s, parts=4)).first()["auc"] > 0.8


def test_permuted_labels_keep_counts(spark):
    u = users(spark)
    p = crossval.permuted_labels(u, 7)
    count = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert count(p) == count(u) and p.count() == 90
    assert p.join(u.select("author", F.col("label").alias("l0")), "author").filter("label <> l0").count() > 0


def test_unknown_models_are_skipped():
    with pytest.warns(UserWarning):
        assert list(models.resolve(["lr", "nonesuch"])) == ["lr"]


def test_poisson_draws(spark):
    w = spark.range(20000).select(resample.poisson_one(F.rand(1)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_bootstrap_interval_holds_mean(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"u{i}", "g", float(x)) for i, x in enumerate(rng.normal(3, 1, 60))] + [("x", "h", 4.0)], "author string, g string, v double")
    got = {r["g"]: r for r in resample.bootstrap_group_means(df, ["g"], "v", "author", 200).collect()}
    assert got["g"]["low"] < got["g"]["mean"] < got["g"]["high"] and got["h"]["low"] == got["h"]["high"] == 4.0


def ridge_reference(x, y, iters=500):
    x = x - x.mean(0)
    m = y.mean()
    y = y - m
    n = len(y)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    e, a, l, old = s**2, 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(iters):
        w = vt.T @ ((s / (e + l / a)) * (u.T @ y))
        r = ((y - x @ w) ** 2).sum()
        g = (a * e / (l + a * e)).sum()
        l, a = (g + 2e-6) / (w @ w + 2e-6), (n - g + 2e-6) / (r + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    return vt.T @ ((s / (e + l / a)) * (u.T @ y)), a, l


def test_ridge_matches_direct_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.normal(0, 0.3, 200) + 2
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    m = ridge.fit_ridge(df, ["a", "b", "c"])
    scaled = (x - x.mean(0)) / x.std(0)
    coef, a, lam = ridge_reference(scaled, y)
    assert np.allclose(m.coef, coef, atol=1e-8) and m.alpha == pytest.approx(a) and m.lam == pytest.approx(lam)
    got = df.select(m.predict().alias("p"), m.deviation().alias("s")).toPandas()
    assert np.allclose(got["p"], scaled @ coef + y.mean(), atol=1e-8)
    assert np.allclose(got["s"], np.sqrt(1 / a + np.einsum("ij,jk,ik->i", scaled, m.sigma, scaled)), atol=1e-8)


def test_ridge_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(a - b + rng.normal(0, 0.1)), float(rng.integers(1, 4))) for a, b in rng.normal(size=(60, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double")
    g = ridge.gram_matrix(df, ["a", "b", "y"], "w")
    x = np.column_stack([np.ones(60), np.array(rows)[:, :3]])
    assert np.allclose(g, (x * np.array(rows)[:, 3:]).T @ x)


def test_redundant_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(3 * a), 1.0, float(b)) for a, b in rng.normal(size=(50, 2))]
    df = spark.createDataFrame(rows, "a double, wide double, flat double, other double")
    assert ridge.drop_redundant(df, ["a", "wide", "flat", "other"]) == ["wide", "other"]


def test_append_keeps_existing_and_first(spark):
    old = spark.createDataFrame([("1", "old", 1)], "id string, v string, t int")
    new = spark.createDataFrame([("1", "new", 2), ("2", "b", 5), ("2", "a", 4)], "id string, v string, t int")
    got = {r["id"]: r["v"] for r in tables.append_keep_first(old, new, "id", [F.col("t")]).collect()}
    assert got == {"1": "old", "2": "a"}


def test_user_list_comment_rule(spark):
    df = spark.createDataFrame([("  ann ",), ("#bob",), (" #carl",), ("",), ("ann",)], "value string")
    assert {r["author"] for r in tables.user_list(df).collect()} == {"ann", "#carl"}


def test_large_catalog_meets_every_request_once(spark):
    from timelens.operators import match
    reqs = spark.range(7).select(F.col("id"), (F.col("id") % 3).alias("k"))
    provs = spark.range(11).select(F.col("id").alias("provider_id"))
    pairs = lambda limit: sorted((r["id"], r["p"]["provider_id"]) for r in match.beside_providers(reqs, provs, limit).collect())
    assert pairs(3) == pairs(100) == [(i, j) for i in range(7) for j in range(11)]
