"""Letter vectors, their cache and the trimming before them."""

from pyspark.sql import functions as F

from timelens.functions import text as tx
from timelens.learn import encode
from timelens.plans import learn_q, views

ODD = ["", " ", "a", " a", "a ", "\n", "a\n", "a \r\n", "a\u0085", " a b ", " é　", "\x1ca\x1c", "a\nb", "İK ſß", "Straße ÀÉ", "🙂 x 🙂", "​a", None]


def test_letters_equal_counts():
    texts = [t for t in ODD if t]
    want = [[t.lower().count(chr(c)) for c in range(97, 123)] for t in texts]
    assert encode.letter_encoder()(texts).tolist() == want
    assert encode.letter_encoder()([]).shape == (0, 26)


def test_strip_equals_pattern(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    both = df.select("t", tx.strip("t").alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert both.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_cached_vectors_are_made_once(spark):
    """the cache was no table, so its posts were encoded for their ids and again for their vectors."""
    out = learn_q.q_encode(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert out.select("id").distinct().count() == views.posts(spark, "/root/testdata/sf0.001").count()


def test_no_text_is_shuffled_to_find_missing_vectors(spark):
    """posts met the cached ids in a join, with their texts in the shuffle."""
    rows = [(f"e{i % 900}" if i % 70 else None, f"Title {i}", "abc" * (i % 7)) for i in range(1000)]
    posts = spark.createDataFrame(rows, "id string, title string, body string").repartition(3)
    cached = encode.encode_posts(posts.filter("id < 'e5'")).cache()
    want = cached.unionByName(encode.encode_posts(posts.join(cached.select("id"), "id", "left_anti")))
    sides = [sorted((r["id"] or "", [*r["embedding"]]) for r in want.collect())]
    # A good filter, one that takes most posts for cached ones, and too many of these to be sent.
    for more in ({}, {"bits_each": 0}, {"bits_each": 0, "most_ids": 3}):
        out = encode.encode_missing(posts, cached, **more)
        sides.append(sorted((r["id"] or "", [*r["embedding"]]) for r in out.collect()))
        assert ("Join" in out._jdf.queryExecution().executedPlan().toString()) == ("most_ids" in more)
    assert all(s == sides[0] for s in sides) and len(sides[0]) == 1000
    none = encode.encode_missing(posts, cached.limit(0))
    assert none.count() == 1000
