import zlib

import numpy as np
import pytest

from timelens.llm import quality
from timelens.llm.entry import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(ready_spark):
    got = QUERIES["op4_quality_empirical_bayes"](ready_spark, SF).toPandas()
    labels = ready_spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[[zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]]
    assert len(got) == 1000
    assert (held.kept == (held.quality == 1)).mean() > 0.97
    assert both[both.quality == 1].kept.mean() > 0.99


def test_sparse_sites_shrink(ready_spark):
    rng = np.random.default_rng(0)
    rows = [(h, p, float(x)) for h, p, n, m in [("big", "a", 400, 3), ("big", "b", 400, -3), ("bad", "a", 300, -4), ("one", "a", 1, -4)] for x in rng.normal(m, .5, n)]
    rows += [(f"h{i}", "a", float(x)) for i in range(20) for x in rng.normal(rng.normal(1, 2), .5, 30)]
    sites, rate = quality.site_posteriors(ready_spark.createDataFrame(rows, "host string, path string, own double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert got["big", "a"].path_rate > 0.9 and got["big", "b"].path_rate < 0.1
    assert got["bad", "a"].path_rate < 0.05 < got["one", "a"].path_rate < rate


def test_strength_by_moments(ready_spark):
    rng = np.random.default_rng(1)
    p = rng.beta(6, 4, 3000)
    rows = [(float(n), float(rng.binomial(n, q)), 0.6) for q, n in zip(p, rng.integers(5, 60, 3000).tolist())]
    assert quality.strength(ready_spark.createDataFrame(rows, "n double, good double, mean double"), "mean") == pytest.approx(10, rel=0.2)


def test_edges(ready_spark, edge, edge_rows, empty):
    labels = ready_spark.createDataFrame([(60 + i, i % 2) for i in range(20)] + [(60, 1), (None, 1), (61, None)], "doc_id long, quality int")
    got = quality.classify(edge, labels)
    assert got.count() == len(edge_rows) and got.where("score IS NULL OR kept IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert quality.classify(empty, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert quality.classify(edge, none).where("kept").count() == len(edge_rows)
    kept = quality.keep_good(edge, labels)
    assert kept.schema == edge.schema
    want = sorted(str(r.doc_id) for r in got.where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert quality.keep_good(empty, labels).count() == 0
