"""Text column builders. Everything is a native column expression; no Python UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define tokens, words, sentences and ellipses (fixed values).
TOKEN = r"(?U)\b[a-z']+\b"
WORD = r"(?U)\b[A-Za-z']+\b"
SENTENCE_END = r"[.!?]+"
ELLIPSIS = r"\.{3,}"
SPACE = r"(?U)\s+"
VOWELS = r"[aeiouy]+"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def compose(first: str | Column, second: str | Column, trim: bool = False) -> Column:
    """``first + ' ' + second`` with nulls as empty text, optionally stripped of white space."""
    text = F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(second), F.lit("")))
    return strip(text) if trim else text


def strip(col: str | Column) -> Column:
    """Trim every kind of white space, not only blanks. Only texts that begin or end with one are read through for it."""
    c = _c(col)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(WORD), F.lit(0))


def sentences(text: str | Column) -> Column:
    return F.filter(F.split(_c(text), SENTENCE_END), lambda s: F.length(strip(s)) > 0)


def count_sentences(text: str | Column) -> Column:
    """Number of non-blank sentences in one pass: runs without an end mark that hold a non-space."""
    return F.regexp_count(_c(text), F.lit(r"(?U)[^.!?\s][^.!?]*"))


def avg_sentence_length(text: str | Column) -> Column:
    """Mean tokens per non-blank sentence (case kept); null when the text has no sentence.

    A sentence break never falls inside a token, so the per-sentence token counts add up to
    the token count of the text and only the number of sentences is needed besides.
    """
    return F.regexp_count(_c(text), F.lit(TOKEN)) / F.nullif(count_sentences(text), F.lit(0))


def hits(token_array: Column, vocabulary: Iterable[str]) -> Column:
    """How many tokens are in the vocabulary."""
    items = list(vocabulary)
    return F.size(F.filter(token_array, lambda t: t.isin(items)))


def phrase_pattern(phrases: Iterable[str], capture: bool = False) -> str:
    """Case-insensitive substring alternation; earlier phrases win at an equal start."""
    body = "|".join(re.sub(r"([^\w\s'])", r"\\\1", p) for p in phrases)
    return f"(?i)({body})" if capture else f"(?i)(?:{body})"


def may_have(text: str | Column, phrases: Iterable[str]) -> Column:
    """Whether the lower-cased text, made once a row, holds one of the phrases as a plain substring: true of every text that has one.
    Nothing is known, so it is true, of phrases that are not ASCII.
    """
    phrases = list(phrases)
    if not phrases or not all(p.isascii() for p in phrases):
        return F.lit(True)
    return F.exists(F.array(F.lower(_c(text))), lambda t: reduce(or_, [t.contains(p.lower()) for p in phrases]))


def has_phrase(text: str | Column, phrases: Iterable[str]) -> Column:
    """Whether a phrase stands in the text. ASCII phrases are looked for as substrings first, so the pattern reads only texts that may match."""
    phrases = list(phrases)
    return may_have(text, phrases) & _c(text).rlike(phrase_pattern(phrases))


def matched_phrase(text: str | Column, phrases: Iterable[str]) -> Column:
    """Leftmost match as written in the text, or null."""
    return F.nullif(F.regexp_extract(_c(text), phrase_pattern(phrases, capture=True), 1), F.lit(""))


def collapse_space(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), SPACE, " ")


def count_char(text: str | Column, char: str) -> Column:
    return (F.length(_c(text)) - F.length(F.replace(_c(text), F.lit(char), F.lit("")))).cast("int")


def count_ellipses(text: str | Column) -> Column:
    return F.regexp_count(_c(text), F.lit(ELLIPSIS))


def count_caps(word_array: Column) -> Column:
    """Words of two characters or more written wholly in capitals."""
    return F.size(F.filter(word_array, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & (F.lower(w) != w)))


def count_blank_separated(text: str | Column) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?U)\S+"))


def count_syllables(text: str | Column) -> Column:
    """Vowel groups, y included."""
    return F.regexp_count(F.lower(_c(text)), F.lit(VOWELS))


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def log_ratio(a: Column, b: Column) -> Column:
    return F.log((a + 1.0) / (b + 1.0))


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    s = F.greatest(n_sentences, F.lit(1))
    return F.when(n_words >= 3, 206.835 - 1.015 * (n_words / s) - 84.6 * (n_syllables / n_words))


def reading_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    s = F.greatest(n_sentences, F.lit(1))
    return F.when(n_words >= 3, 0.39 * (n_words / s) + 11.8 * (n_syllables / n_words) - 15.59)


def compound(valence_sum: Column) -> Column:
    """Squash a summed valence into [-1, 1]."""
    return valence_sum / F.sqrt(valence_sum * valence_sum + 15.0)
