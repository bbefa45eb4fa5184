"""Mean vectors take every post of an author, however many and however short."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from timelens.plans import series_q
from timelens.plans import views as v

T0 = datetime(2024, 6, 1)


def test_every_post_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    many = [("many", f"m{i}", T0 + timedelta(hours=i), "t", "plain words of some length" if i % 2 else "hm") for i in range(130)]
    few = [("few", f"f{i}", T0 + timedelta(hours=i), "t", "plain words of some length") for i in range(3)]
    posts = [(a, i, at, "s", title, body) for a, i, at, title, body in many + few]
    vectors = {p[1]: rng.normal(0, 1, series_q.DIMS).astype(np.float32) for p in posts}
    tables = {"posts": spark.createDataFrame(posts, "author string, id string, created_utc timestamp_ntz, subreddit string, title string, body string"),
              "post_embeddings": spark.createDataFrame([(i, x.tolist()) for i, x in vectors.items()], "id string, embedding array<float>"),
              "labels": spark.createDataFrame([("many",), ("few",), ("none",)], "author string")}
    for name, df in tables.items():
        monkeypatch.setattr(v, name, lambda spark, sf, df=df: df)
    got = {a: np.zeros(series_q.DIMS) for a in ("many", "few", "none")}
    for r in series_q.q_uvec(spark, "unused").collect():
        got[r.author][r.dim] = r.x
    for author, rows in (("many", many), ("few", few)):
        assert got[author] == pytest.approx(np.mean([vectors[r[1]].astype(float) for r in rows], axis=0))
    assert not got["none"].any()
