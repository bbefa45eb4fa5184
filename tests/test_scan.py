"""Counts of texts in numpy against the patterns they stand for."""

import random

import numpy as np
from pyspark.sql import functions as F

from timelens.constants import FIRST_PERSON
from timelens.functions import scan
from timelens.functions import text as tx
from timelens.operators import style

PIECES = ["a", "B", "é", "É", "'", "_", "7", " ", "  ", "\t", "\n", ".", "...", "....", "!", "?", "?!", "I", "i'm", "DON'T", "we", "You", "İ", "K", " ",
          " ", "\u0085", "\x1c", "’", "́", "‍", "²", "ß", "ſ", "Σ", "Ж", "語", "🙂", "𝒜", "x", "Y", "-", "the", "AN", "understandably", "Understandable"]
LISTS = {"n_i": ["i", "i'm", "don't", "understandably", "é", ""], "n_we": ["we", "an"], "n_you": ["you", "the", "k", "b"]}


def by_patterns(posts):
    t, w, text = tx.tokens("text"), tx.words("text"), F.col("text")
    return posts.select("id", F.size(t).alias("n_tokens"), tx.count_char(text, "!").alias("n_excl"), tx.count_char(text, "?").alias("n_ques"),
                        tx.count_ellipses(text).alias("n_ellip"), F.size(w).alias("n_words"), tx.count_caps(w).alias("n_caps"),
                        *[tx.hits(t, LISTS[n]).alias(n) for n in LISTS], tx.count_blank_separated(text).alias("n_blank"),
                        tx.count_sentences(text).alias("n_sentences"), tx.count_syllables(text).alias("n_syllables"),
                        F.regexp_count(text, F.lit(tx.TOKEN)).alias("n_case"))


def test_counts_equal_patterns(spark):
    rnd = random.Random(5)
    texts = ["", " ", "'", "''a''", "a''", "1'a'_", "...", "a.b", "KEY İI", *["".join(rnd.choices(PIECES, k=rnd.randint(1, 25))) for _ in range(4000)]]
    # Every character of the first planes next to a letter.
    texts += ["".join(f"a{chr(c)}'b {chr(c)}c." for c in range(at, at + 64)) for at in [*range(0, 0xD800, 64), *range(0xE000, 0x20000, 64)]]
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4, "id").cache()
    want = by_patterns(posts)
    got = scan.text_counts(posts, ["id"], F.col("text"), [c for c in want.columns if c != "id"], LISTS)
    assert want.schema.names == got.schema.names
    wrong = got.exceptAll(want).orderBy("id").limit(5).collect()
    assert not wrong, [(texts[r["id"]], r, want.filter(F.col("id") == r["id"]).first()) for r in wrong[:2]]
    assert got.count() == len(texts)
    posts.unpersist()


def test_broken_utf8(spark):
    rows = spark.sql("SELECT 0 AS id, CAST(unhex('61FF62 C3 41E28062F4906120C0AF79C3') AS STRING) AS text UNION ALL SELECT 1, CAST(unhex('C3') AS STRING)".replace(" C3 ", "C3"))
    want = by_patterns(rows)
    got = scan.text_counts(rows, ["id"], F.col("text"), [c for c in want.columns if c != "id"], LISTS)
    assert sorted(got.collect()) == sorted(want.collect())


def test_style_reads_no_pattern_a_row(spark):
    """twelve patterns a post were what these queries were bound by."""
    posts = spark.createDataFrame([("u", "1", None, "I AM here! We... you?", None)], "author string, id string, created_utc timestamp_ntz, body string, title string")
    facts = style.style_facts(posts, FIRST_PERSON)
    row = facts.first().asDict()
    assert [row[c] for c in style.COUNTS] == [5, 1, 1, 1, 5, 1, 1, 1, 1, 5, 3, 6] and row["created_utc"] is None
    assert "regexp" not in facts._jdf.queryExecution().executedPlan().toString()
    assert np.array_equal(np.flatnonzero(scan.char_classes(spark)[:33] & scan.BLANK), [9, 10, 11, 12, 13, 32])
