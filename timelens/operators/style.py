"""Punctuation, capitals, pronoun ratios and readability over the four windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FIRST_PERSON, STYLE, UNIT_DAYS, WE_WORDS, WINDOWS, YOU_WORDS
from ..functions import text as tx
from ..functions import timefn as tm
from ..functions.scan import text_counts
from .linguistic import add_deltas
from .turning_point import attach_age

COUNTS = ["n_tokens", "n_excl", "n_ques", "n_ellip", "n_words", "n_caps", "n_i", "n_we", "n_you", "n_blank",
          "n_sentences", "n_syllables"]


def style_facts(posts: DataFrame, i_words=FIRST_PERSON, we_words=WE_WORDS, you_words=YOU_WORDS) -> DataFrame:
    """Integer counts per post; window values are ratios of their sums, so the text stays map-side."""
    lists = {"n_i": list(i_words), "n_we": list(we_words), "n_you": list(you_words)}
    return text_counts(posts, ["author", "id", "created_utc"], tx.compose("body", "title"), COUNTS, lists)


def style_windows(posts: DataFrame, labels: DataFrame, unit_days: int = UNIT_DAYS, **lists) -> DataFrame:
    aged = attach_age(style_facts(posts, **lists), labels)
    flags = tm.window_flags(F.col("age"), unit_days)
    sums = aged.groupBy("author").agg(*[F.sum(F.when(c, F.col(n))).alias(f"{n}_{w}")
                                        for w, c in flags.items() for n in COUNTS])
    cols = []
    for w in WINDOWS:
        g = {n: F.col(f"{n}_{w}") for n in COUNTS}
        some = g["n_tokens"] > 0
        cols += [
            tx.reading_ease(g["n_blank"], g["n_sentences"], g["n_syllables"]).alias(f"flesch_reading_ease_{w}"),
            tx.reading_grade(g["n_blank"], g["n_sentences"], g["n_syllables"]).alias(f"flesch_kincaid_grade_{w}"),
            tx.safe_ratio(g["n_excl"], g["n_tokens"]).alias(f"exclaim_rate_{w}"),
            tx.safe_ratio(g["n_ques"], g["n_tokens"]).alias(f"question_rate_{w}"),
            tx.safe_ratio(g["n_ellip"], g["n_tokens"]).alias(f"ellipsis_rate_{w}"),
            tx.safe_ratio(g["n_caps"], g["n_words"]).alias(f"caps_word_rate_{w}"),
            F.when(some, tx.log_ratio(g["n_i"], g["n_we"])).alias(f"i_vs_we_ratio_{w}"),
            F.when(some, tx.log_ratio(g["n_i"], g["n_you"])).alias(f"i_vs_you_ratio_{w}"),
        ]
    return sums.select("author", *cols)


def style_features(posts: DataFrame, labels: DataFrame, unit_days: int = UNIT_DAYS, **lists) -> DataFrame:
    return add_deltas(style_windows(posts, labels, unit_days, **lists), STYLE)
