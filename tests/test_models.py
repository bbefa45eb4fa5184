"""The model queries, which SQL cannot compute: what must hold for their results on the smallest tables."""

import ast
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q = entry.queries()
CLASSES = {"crisis", "neither", "recovery"}


@pytest.fixture(scope="module")
def users(spark):
    return {r.author: r.label for r in Q["user_labels"](spark, SF).collect()}


@pytest.mark.parametrize("name", ["oof_logistic_regression", "oof_random_forest", "oof_boosted_trees", "stacked_models"])
def test_out_of_fold(spark, users, name):
    rows = Q[name](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.author, []).append(r)
    assert {a: rs[0].label for a, rs in by.items()} == users
    for rs in by.values():
        assert {r["class"] for r in rs} == CLASSES and len(rs) == 3 and len({r.fold for r in rs}) == 1
        assert sum(r.score for r in rs) == pytest.approx(1, abs=1e-5) and all(0 <= r.score <= 1 for r in rs)


@pytest.mark.parametrize("name,keys", [("grid_search", {"c"}), ("random_search", {"trees", "depth", "min_leaf"})])
def test_searches(spark, name, keys):
    rows = Q[name](spark, SF).collect()
    aucs = [r.auc for r in rows if r.auc is not None]
    assert aucs == sorted(aucs, reverse=True) and all(0 <= a <= 1 for a in aucs)
    assert sorted(r.trial for r in rows) == list(range(len(rows)))
    assert all(set(ast.literal_eval(r.params)) == keys for r in rows)


def test_importance(spark):
    rows = Q["feature_importance"](spark, SF).collect()
    values = [r.importance for r in rows]
    assert values == sorted(values, reverse=True) and all(v >= 0 for v in values) and sum(values) <= 1 + 1e-9
    assert len({r.feature for r in rows}) == len(rows) <= 15


def test_permutation(spark):
    r = Q["permutation_test"](spark, SF).first()
    assert 0 < r.p_value <= 1 and (r.observed is None or 0 <= r.observed <= 1)


def test_experiment(spark):
    rows = Q["experiment_metrics"](spark, SF).collect()
    assert {r.model for r in rows} == {"lr", "rf"} and {r.dataset for r in rows} <= {"full", "high_conf"}
    assert all(r.value is None or r.value == r.value for r in rows)


def test_ridge_queries(spark):
    pred = Q["bayesian_ridge_predictions"](spark, SF).agg(F.count(F.lit(1)).alias("n"), F.min("std").alias("s"), F.corr("y", "p").alias("r")).first()
    assert pred.n > 0 and pred.s >= 0 and pred.r > 0
    kinds = {r.model for r in Q["ranked_ridge_model"](spark, SF).collect()}
    assert len(kinds) == 1
    assert Q["ridge_cross_validation"](spark, SF).count() > 0


def test_feature_tables(spark, users):
    wide = Q["kitchen_sink_matrix"](spark, SF)
    assert {r.author for r in wide.select("author").collect()} == set(users) and len(wide.columns) == len(set(wide.columns)) > 121
    kept = Q["redundant_feature_filter"](spark, SF).collect()
    assert any(r.kept for r in kept) and len({r.feature for r in kept}) == len(kept)


def test_change_points(spark):
    assert Q["change_points"](spark, SF).count() > 0
    assert set(Q["change_point_pipeline"](spark, SF).columns) >= {"label", "n_users"}
