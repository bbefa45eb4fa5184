"""Posts that hold a phrase."""

import re

from pyspark.sql import functions as F

from timelens.operators.turning_point import LabelRules, matches

TEXTS = ["I Quit now", "it got WORSE", "quitter", "worse, I quit", "nothing", "", None, "quİt", "Straße QUIT", "Keep"]


def found(posts, rules):
    return {r["id"]: (r["label"], r["phrase"]) for r in matches(posts, rules).collect()}


def test_matches_equal_patterns(spark):
    posts = spark.createDataFrame([("u", str(i), None, "s", None, t) for i, t in enumerate(TEXTS)],
                                  "author string, id string, created_utc timestamp_ntz, subreddit string, title string, body string")
    for crisis, recovery in ((["worse", "keep"], ["quit"]), (["straße"], ["quit"]), ([], ["quit"])):
        want = {}
        for i, t in enumerate(TEXTS):
            for label, phrases in (("crisis", crisis), ("recovery", recovery)):
                # Spark's patterns fold ASCII letters only.
                hit = re.search("|".join(map(re.escape, phrases)), " " + (t or ""), re.I | re.A)
                if hit:
                    want.setdefault(str(i), (label, hit.group() or None))
        assert found(posts, LabelRules(crisis=crisis, recovery=recovery)) == want


def test_posts_are_lowered_once_for_both_kinds(spark):
    """A post without a phrase was lower-cased once for each kind."""
    posts = spark.createDataFrame([("u", "1", None, "s", "t", "b")], "author string, id string, created_utc timestamp_ntz, subreddit string, title string, body string")
    first = matches(posts, LabelRules(crisis=["worse"], recovery=["quit"])).filter(F.col("id") > "")._jdf.queryExecution().optimizedPlan().toString()
    looks = first.split("exists(")[1:]
    assert any("worse" in look.split("RLIKE")[0] and "quit" in look.split("RLIKE")[0] for look in looks)
