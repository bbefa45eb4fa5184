"""Hand-made timelines for the rules that ordinary data seldom meets."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.constants import CRISIS_PHRASES, RECOVERY_PHRASES
from timelens.functions import text as tx
from timelens.operators import changepoint, clean, linguistic, semantic, style, temporal, turning_point, weekly, zscore

T0 = datetime(2024, 6, 1, 12)
SCHEMA = "author string, id string, created_utc timestamp_ntz, subreddit string, title string, body string"


def post(author, i, days, body="plain words here", title="t"):
    return (author, f"{author}{i}", T0 + timedelta(days=days), "s", title, body)


def timeline(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 2), ("bad", -3)], "word string, valence int")


def labels_of(spark, rows, **kw):
    rules = turning_point.LabelRules(min_posts=0, **kw)
    return {r["author"]: r for r in turning_point.label_users(timeline(spark, rows), rules).collect()}


def test_label_rules(spark):
    rows = [post("both", 0, -60), post("both", 1, 0, "I made it but want to die"),
            post("late", 0, -3), post("late", 1, 0, "goodbye"), post("late", 2, 60, "I want to die"),
            post("rec", 0, -60), post("rec", 1, 0, "finally I Made It"),
            post("tie", 0, -60), post("tie", 2, 0, "goodbye"), post("tie", 1, 0, "got help"),
            post("none", 0, 0)]
    got = labels_of(spark, rows)
    assert got["both"]["label"] == "crisis" and got["both"]["tp_matched_phrase"] == "want to die"
    assert got["late"]["label"] == "neither" and got["late"]["tp_date"] is None
    assert got["rec"]["label"] == "recovery" and got["rec"]["low_confidence"]
    assert got["rec"]["tp_matched_phrase"] == "Made It"
    assert got["tie"]["label"] == "recovery" and got["tie"]["tp_post_id"] == "tie1"
    assert got["none"]["label"] == "neither" and got["none"]["anchor"] == T0


def test_baseline_must_be_strictly_older(spark):
    at = labels_of(spark, [post("a", 0, -28), post("a", 1, 0, "goodbye")])
    older = labels_of(spark, [post("a", 0, -28.001), post("a", 1, 0, "goodbye")])
    assert at["a"]["label"] == "neither" and older["a"]["label"] == "crisis"


def test_min_posts_is_strict(spark):
    df = timeline(spark, [post("a", i, i) for i in range(10)] + [post("b", i, i) for i in range(11)])
    assert {r["author"] for r in clean.active_authors(df).collect()} == {"b"}


def test_window_bounds_are_half_open(spark):
    days = [-28.0001, -28, -14, -7, 0, 1]
    df = timeline(spark, [post("a", i, d) for i, d in enumerate(days)])
    labels = spark.createDataFrame([("a", T0)], "author string, anchor timestamp_ntz")
    from timelens.functions import timefn as tm
    aged = turning_point.attach_age(df, labels)
    got = aged.agg(*[F.count(F.when(c, 1)).alias(w) for w, c in tm.window_flags(F.col("age"), 7).items()]).first()
    assert got.asDict() == {"baseline": 1, "pre_4w": 3, "pre_2w": 2, "pre_1w": 1}


def anchored(spark, *authors):
    return spark.createDataFrame([(a, T0) for a in authors], "author string, anchor timestamp_ntz")


def test_empty_windows(spark, lexicon):
    df = timeline(spark, [post("a", 0, 0)])
    r = linguistic.raw_features(df, anchored(spark, "a"), lexicon).first()
    assert r["post_freq_pre_1w"] == 0.0 and r["post_freq_baseline"] == 0.0 and r["post_freq_delta_pre_1w"] == 0.0
    assert r["ttr_pre_1w"] is None and r["sentiment_mean_delta_pre_4w"] is None


def test_linguistic_values(spark, lexicon):
    rows = [post("a", 0, -40, "Good good bad. I cry!", ""), post("a", 1, -3, "good day", ""), post("a", 2, -2, "my bad day", "")]
    r = linguistic.raw_features(timeline(spark, rows), anchored(spark, "a"), lexicon).first()

    def comp(s):
        return s / np.sqrt(s * s + 15)
    assert r["sentiment_mean_pre_1w"] == pytest.approx((comp(2) + comp(-3)) / 2)
    assert r["ttr_pre_1w"] == pytest.approx(4 / 5)
    assert r["fp_pronoun_rate_pre_1w"] == pytest.approx(1 / 5)
    assert r["neg_affect_rate_baseline"] == pytest.approx(1 / 5)
    # capitals do not count in sentence length: "good bad" and "cry"
    assert r["avg_sent_len_baseline"] == pytest.approx((2 + 1) / 2)
    assert r["post_freq_pre_4w"] == pytest.approx(2 / 4) and r["post_freq_baseline"] == 1.0


def test_zscore_needs_two_varied_buckets(spark, lexicon):
    one = [post("one", 0, -30), post("one", 1, -1)]
    flat = [post("flat", i, -29 - 7 * i) for i in range(3)] + [post("flat", 9, -1)]
    df = timeline(spark, one + flat)
    z = {r["author"]: r for r in zscore.zscore_features(df, anchored(spark, "one", "flat"), lexicon).collect()}
    assert z["one"]["n_baseline_buckets"] == 1 and z["one"]["post_freq_znorm_pre_1w"] is None
    assert z["flat"]["n_baseline_buckets"] == 3 and z["flat"]["post_freq_znorm_pre_1w"] is None
    assert z["one"]["has_posts_pre_1w"] == 1.0


def test_bucket_border(spark, lexicon):
    df = timeline(spark, [post("a", 0, -35), post("a", 1, -35.0001), post("a", 2, -28.0001)])
    b = zscore.bucket_features(df, anchored(spark, "a"), lexicon)
    assert {r["bucket"]: r["post_freq"] for r in b.collect()} == {0: 2.0, 1: 1.0}


def test_interval_stats(spark):
    rows = [post("two", 0, -2), post("two", 1, -1), post("three", 0, -3), post("three", 1, -2), post("three", 2, -0.5), post("one", 0, -1)]
    r = {x["author"]: x for x in temporal.temporal_features(timeline(spark, rows), anchored(spark, "one", "two", "three")).collect()}
    assert r["one"]["interval_mean_hr_pre_1w"] is None and r["one"]["hour_entropy_pre_1w"] == pytest.approx(0.0)
    assert r["two"]["interval_mean_hr_pre_1w"] == 24.0 and r["two"]["interval_std_hr_pre_1w"] is None
    assert r["three"]["interval_std_hr_pre_1w"] == pytest.approx(np.std([24, 36], ddof=1))


def test_gaps_across_chunks_match_plain_lag(spark):
    rng = np.random.default_rng(3)
    rows = [post("a", i, -float(d)) for i, d in enumerate(np.round(rng.uniform(0.01, 60, 300), 1))]
    aged = turning_point.attach_age(timeline(spark, rows), anchored(spark, "a"))
    got = sorted((r["prev_age"] - r["age"]) for r in temporal.gaps(aged, 7 * 86_400_000_000).collect())
    ages = sorted(r["age"] for r in aged.select("age").collect())
    assert got == sorted(np.diff(ages).tolist())


def test_style(spark):
    rows = [post("a", 0, -1, "WOW... I SAID no!! We will? I'm ok....", ""), post("b", 0, -1, "hi", "")]
    r = {x["author"]: x for x in style.style_features(timeline(spark, rows), anchored(spark, "a", "b")).collect()}
    assert r["a"]["ellipsis_rate_pre_1w"] == pytest.approx(2 / 8) and r["a"]["exclaim_rate_pre_1w"] == pytest.approx(2 / 8)
    assert r["a"]["caps_word_rate_pre_1w"] == pytest.approx(2 / 8)
    assert r["a"]["i_vs_we_ratio_pre_1w"] == pytest.approx(np.log(2 / 2))
    assert r["b"]["flesch_reading_ease_pre_1w"] is None


def test_tokens_follow_unicode_borders(spark):
    df = spark.createDataFrame([("don't café 'hello' i_x x1 naïve end",)], "t string")
    assert df.select(tx.tokens("t")).first()[0] == ["don't", "hello", "end"]


def test_leftmost_phrase_and_order(spark):
    df = spark.createDataFrame([("so KILL MYSELF or goodbye",), ("Doing better, got help",), ("fine",)], "t string")
    got = [r[0] for r in df.select(F.coalesce(tx.matched_phrase("t", CRISIS_PHRASES), tx.matched_phrase("t", RECOVERY_PHRASES))).collect()]
    assert got == ["KILL MYSELF", "Doing better", None]


def test_zero_and_missing_vectors(spark):
    df = timeline(spark, [post("z", 0, -40), post("z", 1, -1), post("m", 0, -40), post("m", 1, -1)])
    vecs = spark.createDataFrame([("z0", [0.0, 0.0]), ("z1", [1.0, 0.0]), ("m0", [1.0, 0.0])], "id string, embedding array<float>")
    r = {x["author"]: x for x in semantic.semantic_features(df, anchored(spark, "z", "m"), vecs).collect()}
    assert r["z"]["cos_sim_pre_1w"] is None and r["z"]["l2_dist_pre_1w"] == 1.0
    assert r["m"]["l2_dist_pre_1w"] is None


def test_weekly_series_fills_gaps(spark):
    monday, tuesday = datetime(2024, 6, 3, 23), datetime(2024, 6, 4)
    rows = [("a", monday, 1.0), ("a", tuesday, 2.0), ("a", tuesday + timedelta(days=21), 5.0)]
    s = weekly.weekly_series(spark.createDataFrame(rows, "author string, created_utc timestamp_ntz, v double"), "v")
    got = [(r["week"], r["value"]) for r in s.orderBy("week").collect()]
    starts = [datetime(2024, 5, 28) + timedelta(days=7 * i) for i in range(5)]
    assert got == list(zip(starts, [1.0, 2.0, 2.0, 2.0, 5.0]))


def brute(values, penalty, least, jump):
    n, best = len(values), (np.inf, [])
    from itertools import combinations
    marks = [k for k in range(jump, n, jump)]
    for r in range(len(marks) + 1):
        for cut in combinations(marks, r):
            edges = [0, *cut, n]
            if any(b - a < least for a, b in zip(edges, edges[1:])):
                continue
            cost = sum(((values[a:b] - values[a:b].mean()) ** 2).sum() + penalty for a, b in zip(edges, edges[1:]))
            if cost < best[0] - 1e-12:
                best = (cost, list(cut))
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_segments_are_optimal(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(m, 0.5, rng.integers(3, 12)) for m in rng.normal(0, 2, 3)])
    for least, jump in ((2, 5), (2, 3)):
        assert changepoint.segment(v, 1.5, least, jump) == brute(v, 1.5, least, jump)


def test_change_point_distance(spark):
    weeks = [datetime(2024, 1, 2) + timedelta(days=7 * i) for i in range(20)]
    rows = [("a", w, 0.0 if i < 10 else 5.0) for i, w in enumerate(weeks)] + [("b", w, 1.0) for w in weeks] + [("c", weeks[0], 1.0)]
    cps = changepoint.change_points(spark.createDataFrame(rows, "author string, week timestamp_ntz, value double"))
    labels = spark.createDataFrame([("a", "crisis", weeks[10] + timedelta(days=3, hours=1)), ("b", "recovery", weeks[1])],
                                   "author string, label string, tp_date timestamp_ntz")
    d = {r["author"]: r for r in changepoint.nearest_distance(cps, labels).collect()}
    assert set(d) == {"a", "b"} and d["a"]["distance"] == pytest.approx(4 / 7) and d["b"]["distance"] == float("inf")
