"""Training log: numbers claimed by concurrent writers, its fields, and the digest of the ordered labels."""

import hashlib
import json
import multiprocessing
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.operators import ranking
from timelens.schema import METRICS
from timelens.sources import tables


def one_row(spark, model):
    return spark.createDataFrame([(model, 0.5)], "model_type string, rmse double")


def test_writers_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(12) as pool:
        list(pool.map(lambda i: tables.append_run(spark, path, one_row(spark, f"m{i}")), range(12)))
    rows = tables.read_runs(spark, path, one_row(spark, "m").schema).collect()
    assert sorted(r["run"] for r in rows) == list(range(1, 13))
    assert sorted(r["model_type"] for r in rows) == sorted(f"m{i}" for i in range(12))


def _claims(path, numbers):
    """Another process that claims by the same files."""
    os.makedirs(path, exist_ok=True)
    n = 0
    while len(numbers) < 20:
        n += 1
        try:
            os.close(os.open(f"{path}/{n}", os.O_CREAT | os.O_EXCL))
            numbers.append(n)
        except FileExistsError:
            pass


def test_another_process_never_gets_the_same_number(spark, tmp_path):
    path = str(tmp_path / "log")
    with multiprocessing.get_context("spawn").Manager() as manager:
        theirs = manager.list()
        other = multiprocessing.get_context("spawn").Process(target=_claims, args=(f"{path}/_claims", theirs))
        other.start()
        mine = [tables.claim_run(spark, path) for _ in range(20)]
        other.join(60)
        assert sorted([*mine, *theirs]) == list(range(1, 41))


def test_a_writer_that_died_leaves_a_gap_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_run(spark, path, one_row(spark, "a"))
    assert tables.claim_run(spark, path) == 2
    log = tables.append_run(spark, path, one_row(spark, "b").withColumn("ndcg5", F.lit(0.9)))
    assert {(r["run"], r["model_type"], r["ndcg5"]) for r in log.collect()} == {(1, "a", None), (3, "b", 0.9)}


@pytest.mark.parametrize("values", [[], [0.25], [1.0, 0.3, 0.3, 0.0, 1e-07, 123456789.5], [0.5, None, 1.0]])
def test_list_hash_is_the_digest_of_the_json_list(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, y double").repartition(4, "y")
    want = hashlib.md5(json.dumps(values).encode()).hexdigest()[:8]
    assert ranking.list_hash(df, "id", "y").first()["data_hash"] == want


def test_run_record(spark):
    rng = np.random.default_rng(3)
    y, p = rng.choice([0.0, 0.3, 0.6, 1.0], 200), rng.random(200)
    rows = [(i, float(y[i]), float(p[i]), "x" if p[i] > 0.5 else "z") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y double, p double, g string")
    got = ranking.run_record(df, "plain", 7, {"split": {n: F.col("g") == n for n in "xz"}, "none": {n: F.col("id") % 2 == i for i, n in enumerate("ab")}}).first()
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["rmse"] == pytest.approx(round(float(np.sqrt(np.mean((y - p) ** 2))), 5))
    assert got["mae"] == pytest.approx(round(float(np.mean(abs(y - p))), 5))
    assert got["spearman"] == pytest.approx(round(float(np.corrcoef(rank(y), rank(p))[0, 1]), 5))
    assert (got["samples"], got["features"], got["model_type"], got["fairness_flags"]) == (200, 7, "plain", 1)
    assert got["data_hash"] == hashlib.md5(json.dumps([float(v) for v in y]).encode()).hexdigest()[:8]
    assert got["trained_at"].endswith("Z")


def test_metric_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    blank = spark.createDataFrame([tuple(None for _ in METRICS.fields)] * 3, METRICS)
    tables.write_metrics(blank.repartition(3), path)
    tables.write_metrics(blank, path)
    assert tables.read_metrics(spark, path).count() == 6
