"""Distinct tokens per span, large lexicons, weekly series, centroids and phrase search: same results, work that follows the input."""

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from timelens.functions import text as tx
from timelens.operators import linguistic, semantic, weekly


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_distinct_counts(spark):
    rows = [("a", [-1, 0], ["x", "y", "x"]), ("a", [-1, 1], ["y", "it's"]), ("a", [-2], ["z"]), ("b", [-1, 0], []), ("b", [-2, -3], ["x"])]
    rows += [("hot", [-1, i % 3], [f"w{chr(97 + j % 26)}" for j in range(i % 40)]) for i in range(500)]
    marked = spark.createDataFrame(rows, "author string, codes array<long>, tokens array<string>")
    want = {}
    for author, codes, tokens in rows:
        for c in codes:
            want.setdefault((author, c), set()).update(tokens)
    want = {k: len(v) for k, v in want.items() if v}
    for slices, per_task in ((4, 10_000), (1, 10), (7, 100)):
        got = linguistic.distinct_counts(marked, slices, per_task)
        assert {(r["author"], r["code"]): r["kinds"] for r in got.collect()} == want
    # Tokens become rows behind the shuffle that deals them: nothing is shuffled by token.
    moved = [line for line in plan(linguistic.distinct_counts(marked)).splitlines() if "Exchange" in line]
    assert len(moved) == 2 and not any("token" in line for line in moved)


def test_large_lexicon_meets_rare_tokens_only(spark):
    posts = [(f"u{i % 5}", f"p{i}", ["the", "of", f"word{i}", "the", f"w{i % 7}"] if i % 11 else None) for i in range(400)]
    tokenised = spark.createDataFrame(posts, "author string, id string, tokens array<string>")
    words = [("the", 2), ("w1", -3)] + [(f"word{i}", i % 5 - 2) for i in range(0, 400, 2)]
    lexicon = spark.createDataFrame(words, "word string, valence int")

    def sums(limit):
        got = linguistic.token_sums(tokenised, lexicon, ["author", "id"], {"n_the": ["the"]}, lexicon_rows=limit)
        return sorted(map(tuple, got.collect()))

    val = dict(words)
    want = []
    for author, key, tokens in posts:
        s = float(sum(val.get(t, 0) for t in tokens or []))
        want.append((author, key, len(tokens or []), (tokens or []).count("the"), s / (s * s + 15.0) ** 0.5))
    for limit in (1_000, 10):
        assert [(*r[:4], round(r[4], 9)) for r in sums(limit)] == [(*r[:4], round(r[4], 9)) for r in sorted(want)]
    frequent = {r["token"] for r in linguistic.frequent_words(tokenised, one_in=1).collect()}
    assert {"the", "of"} <= frequent and not any(t.startswith("word") for t in frequent)


def test_weekly_series_fills_without_a_grid_join(spark):
    start = datetime(2024, 1, 2)
    rows = [("a", start, 1.0), ("a", start + timedelta(days=1), 3.0), ("a", start + timedelta(days=22), 5.0), ("a", start + timedelta(days=30), None),
            ("b", start, None), ("c", start + timedelta(days=8), 7.0), (None, start, 4.0), (None, start + timedelta(days=14), 4.0), ("d", None, 1.0)]
    scored = spark.createDataFrame(rows, "author string, created_utc timestamp_ntz, x double")
    series = weekly.weekly_series(scored, "x")
    got = sorted(((r["author"] or "", r["week"], r["value"]) for r in series.collect()), key=lambda r: r[:2])
    week = [start + timedelta(days=7 * i) for i in range(4)]
    assert got == [("", week[0], None), ("", week[1], None), ("", week[2], None), ("a", week[0], 2.0), ("a", week[1], 2.0), ("a", week[2], 2.0),
                   ("a", week[3], 5.0), ("c", week[1], 7.0)]
    assert "Join" not in plan(series)


def test_vectors_are_dealt_by_author_before_they_become_rows(spark):
    anchor = datetime(2024, 6, 1)
    rows = [("hot" if i % 3 else f"u{i % 8}", f"p{i}", anchor - timedelta(hours=i)) for i in range(300)]
    posts = spark.createDataFrame(rows, "author string, id string, created_utc timestamp_ntz")
    labels = spark.createDataFrame([(a, anchor) for a in {r[0] for r in rows}], "author string, anchor timestamp_ntz")
    vectors = spark.createDataFrame([(f"p{i}", [float(i), float(-i % 7)]) for i in range(300)], "id string, embedding array<float>")
    made = semantic.window_centroids(posts, labels, vectors, 1)
    inside = {"baseline": lambda h: h > 96, "pre_4w": lambda h: 0 < h <= 96, "pre_2w": lambda h: 0 < h <= 48, "pre_1w": lambda h: 0 < h <= 24}
    for r in made.collect():
        for w, ok in inside.items():
            xs = [(float(i), float(-i % 7))[r["dim"]] for i, (a, _, _) in enumerate(rows) if a == r["author"] and ok(i)]
            assert (r[w] is None) if not xs else abs(r[w] - sum(xs) / len(xs)) < 1e-9
    steps = plan(made)
    assert steps.index("Generate posexplode") < steps.index("REBALANCE")


def test_phrases_are_looked_for_as_substrings_first(spark):
    texts = ["I Want To Die", "want to  die", None, "", "WANT TO DIE\nx", "\u0130 want to die", "\u212aill me", "kill me", "a+b", "aab", "stra\u00dfe", "STRASSE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for phrases in (["want to die", "Kill Me"], ["a+b"], ["stra\u00dfe", "kill me"], [], ["it's"]):
        got = df.select(tx.has_phrase("t", phrases).alias("a"), F.col("t").rlike(tx.phrase_pattern(phrases)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
    # The pattern comes after the substrings.
    assert "exists(array(lower(" in plan(df.filter(tx.has_phrase("t", ["want to die"])))


def test_known_words_move_as_numbers(spark):
    """Frequent words are a byte or two of a post's row, an author that is not hot moves one row a post, and counts stay exact."""
    from timelens.operators import span_codes
    words = [f"word{i}" for i in range(40_000)]
    rows = []
    for i in range(900):
        tokens = [words[(i * 31 + j * j * 7) % len(words)] for j in range(i % 90)] + [f"rare{i % 50}", "it's"]
        rows.append(("hot" if i % 3 else f"u{i % 8}", [-1, i % 4] if i % 5 else [-2], tokens if i % 11 else None))
    marked = spark.createDataFrame(rows, "author string, codes array<long>, tokens array<string>")
    want = {}
    for author, codes, tokens in rows:
        for c in codes:
            want.setdefault((author, c), set()).update(tokens or [])
    want = {k: len(v) for k, v in want.items() if v}
    for per_task in (10_000, 100):
        got = linguistic.distinct_counts(marked, 4, per_task, words)
        assert {(r["author"], r["code"]): r["kinds"] for r in got.collect()} == want
    known = spark.sparkContext.broadcast(words)
    packed = marked.select("author", "codes", F.lit(False).alias("_hot"), "tokens").mapInArrow(span_codes.packer(known, 4), f"author string, {span_codes.PACKED}")
    moved = packed.agg(F.count(F.lit(1)), F.sum(F.length("_known") + F.length("_other"))).first()
    spelled = sum(len(" ".join(dict.fromkeys(t or []))) for *_, t in rows)
    assert moved[0] == sum(1 for r in rows if r[2]) and moved[1] < spelled / 2.5
