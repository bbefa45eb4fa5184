"""Token sums and distinct tokens read from the bytes of many posts: the same as from token rows, without a row a token."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from timelens.functions import scan
from timelens.functions import text as tx
from timelens.operators import linguistic, span_codes, weekly

from .test_scan import PIECES
from .test_span_tokens import plan

LISTS = {"n_first": ["i", "i'm", "zzz", "É"], "n_negative": ["the", "understandably", "the"]}
START = datetime(2024, 1, 1)


def some_posts(spark, n=1500):
    rnd = random.Random(7)
    long = ["a" * 16, "a" * 17, "b'" * 12 + "b", "Incomprehensibilities"]
    text = lambda: "".join(rnd.choices([*PIECES, " ", " ", *long], k=rnd.randint(0, 30)))
    rows = [(rnd.choice(["u1", "u2", "hot", None]), f"p{i}", START + timedelta(hours=i), rnd.choice([None, text(), text(), text()]), rnd.choice([None, "", " ", text()])) for i in range(n)]
    # Repeated rows and rows without an id or a time.
    rows += [*rows[:40], *rows[:5], ("u1", None, None, "the i'm a", "x"), ("u1", None, None, "the i'm a", "x")]
    return spark.createDataFrame(rows, "author string, id string, created_utc timestamp_ntz, body string, title string").repartition(4).cache()


def lexicon(spark):
    words = [("the", 2.5), ("i", -1.0), ("a", 3.0), ("The", 50.0), ("a" * 16, 7.0), ("a" * 17, 11.0), ("b'" * 12 + "b", 13.0), ("x", None), ("i'm", 1.5),
             ("we", 1.0), ("we", 2.0), (None, 9.0), ("é", 99.0), ("", 5.0), ("understandably", -2.0)]
    return spark.createDataFrame(words, "word string, valence double")


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_text_sums_equal_token_rows(spark):
    posts, lex, text = some_posts(spark), lexicon(spark), tx.compose("body", "title")
    keep = ["author", "id", "created_utc"]
    facts = linguistic.post_tokens(posts).withColumn("sent_len", tx.avg_sentence_length("text")).select(*keep, "sent_len", "tokens")
    want = linguistic.token_sums(facts, lex, [*keep, "sent_len"], LISTS)
    got = linguistic.post_facts(posts, lex, LISTS["n_first"], LISTS["n_negative"])
    assert got.schema.simpleString() == want.schema.simpleString()
    assert rounded(got) == rounded(want)
    # A lexicon that is too large to be sent, and one without words.
    once = lex.filter("word <> 'we'")
    assert rounded(linguistic.text_sums(posts, keep, text, once, LISTS, lexicon_rows=3)) == rounded(linguistic.text_sums(posts, keep, text, once, LISTS))
    none = linguistic.text_sums(posts, keep, text, lex.limit(0), {})
    assert rounded(none) == rounded(linguistic.token_sums(linguistic.post_tokens(posts), lex.limit(0), keep, {}))
    posts.unpersist()


def test_no_token_becomes_a_row(spark):
    """Posts were cut by a pattern and every token was a row that met the lexicon in a join."""
    posts, lex = some_posts(spark, 20), lexicon(spark)
    for made in (linguistic.post_facts(posts, lex), weekly.post_scores(posts, lex)):
        steps = plan(made)
        assert "Generate" not in steps and "regexp_extract_all" not in steps and "Join" not in steps
    posts.unpersist()


def test_distinct_in_texts_equals_token_arrays(spark):
    posts, text = some_posts(spark).filter("created_utc is not null and author is not null"), tx.compose("body", "title")
    spans = lambda df: df.withColumn("codes", F.array(F.lit(-1).cast("long"), F.hour("created_utc").cast("long")))
    marked = spans(posts.withColumn("tokens", tx.tokens(text)))
    want = rounded(linguistic.distinct_counts(marked))
    words = ["the", "a", "i'm", "a" * 16, "a" * 17, "understandably", "b"]
    for listed, per_task in ((words, 10_000), (words, 100), ([], 10_000)):
        assert rounded(linguistic.distinct_in_texts(posts, text, spans, listed, 4, per_task)) == want


def test_counter_marks_and_sorts_alike(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = [(f"u{i // 60}", [-1, i % 5], rnd.sample(words, rnd.randint(0, 90))) for i in range(600)]
    want = {}
    for author, codes, tokens in rows:
        for c in codes:
            want.setdefault((author, c), set()).update(tokens)
    marked = spark.createDataFrame(rows, "author string, codes array<long>, tokens array<string>")
    for marks in (1, 1 << 12, 1 << 24):
        monkeypatch.setattr(span_codes, "MARKS", marks)
        got = linguistic.distinct_counts(marked, words=words).collect()
        assert {(r["author"], r["code"]): r["kinds"] for r in got} == {k: len(v) for k, v in want.items() if v}


def test_word_finder():
    words = ["a", "it's", "abcdefgh", "abcdefghi", "p" * 16, "p" * 17, "Up", "é", "", "zz"]
    table, find = scan.word_finder()
    tokens = ["A", "it's", "IT'S", "abcdefgh", "abcdefghi", "abcdefghj", "p" * 16, "P" * 17, "p" * 18, "up", "z", "zz"]
    raw = pa.array(tokens).buffers()[2].to_pybytes()[:sum(map(len, tokens))]
    import numpy as np
    sizes = np.array([len(t) for t in tokens])
    got = find(table(words), np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [0, 1, 1, 2, 3, -1, 4, 5, -1, -1, -1, 9]
    many = sorted({f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000)})
    raw = np.frombuffer("".join(many).encode(), np.uint8)
    start = np.arange(len(many)) * 3
    assert find(table(many), raw, start, np.full(len(many), 3)).tolist() == list(range(len(many)))
    assert find(table(many[::2]), raw, start, np.full(len(many), 3)).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(many))]
