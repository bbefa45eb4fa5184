"""Per-post text facts and the linguistic feature family over four nested windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIRST_PERSON, LINGUISTIC, NEGATIVE_WORDS, PRE_WINDOWS, UNIT_DAYS, WINDOWS
from ..functions import scan
from ..functions import text as tx
from ..functions import timefn as tm
from ..session import materialize
from . import span_codes
from .turning_point import attach_age

#: Words of a lexicon that are sent to every task, and the posts' frequent words that are sent when it has more.
LEXICON_ROWS, FREQUENT_WORDS = 1 << 22, 1 << 18
#: Parts a hot author's tokens are dealt by, and posts whose tokens a task counts.
SLICES, POSTS_PER_TASK = 4, 10_000


def post_tokens(posts: DataFrame, *keep: str) -> DataFrame:
    """Slim rows ``(author, id, created_utc, text, tokens)``; body before title."""
    return (posts.select("author", "id", "created_utc", *keep, tx.compose("body", "title").alias("text"))
            .withColumn("tokens", tx.tokens("text")))


def token_sums(tokenised: DataFrame, lexicon: DataFrame, keep: list[str], vocabularies: dict[str, list[str]],
               lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """Token count, hits per vocabulary and lexicon sentiment per post; ``keep`` holds the post's ``id``.

    A lexicon of up to ``lexicon_rows`` words goes to the posts, and their tokens are summed in the same task before the
    shuffle, so one row per post moves. Of a larger one the posts' frequent words go there; only the other tokens, the
    rare ones, meet the rest of the lexicon by token.
    """
    lex = lexicon.select(F.col("word").alias("token"), "valence")
    rows = tokenised.select(*keep, F.explode_outer("tokens").alias("token"))
    if lex.count() <= lexicon_rows:
        scored = rows.join(F.broadcast(lex), "token", "left")
    else:
        known = F.broadcast(materialize(frequent_words(tokenised).join(lex, "token", "left"), "frequent_words"))
        rare = rows.join(F.broadcast(known.select("token")), "token", "left_anti").join(lex, "token")
        scored = rows.join(known, "token", "left").unionByName(rare.withColumn("token", F.lit(None).cast("string")))
    hits = [F.count(F.when(F.col("token").isin(list(words)), 1)).alias(name) for name, words in vocabularies.items()]
    return scored.groupBy(*keep).agg(
        F.count("token").alias("n_tokens"), *hits,
        tx.compound(F.coalesce(F.sum("valence"), F.lit(0)).cast("double")).alias("sentiment"))


def text_sums(posts: DataFrame, keep: list[str], text: Column, lexicon: DataFrame, vocabularies: dict[str, list[str]], counts: list[str] = [],
              derived: dict[str, Column] = {}, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:  # noqa: B006
    """``token_sums`` of the tokens of ``text``, grouped by ``keep`` and ``derived``, columns made of the whole numbers ``counts`` of ``scan``.

    A lexicon of up to ``lexicon_rows`` words goes to the tasks, which read the bytes of many posts at once: no token becomes a row.
    """
    groups, lex = [*keep, *derived], lexicon.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("valence").cast("double").alias("v"))
    if lexicon.count() > lexicon_rows:
        cases = {"n_case": F.regexp_count("_t", F.lit(tx.TOKEN)), "n_sentences": tx.count_sentences("_t")}
        rows = posts.select(*keep, text.alias("_t")).withColumns({c: cases[c] for c in counts}).withColumn("tokens", tx.tokens("_t"))
        return token_sums(rows.withColumns(derived).select(*groups, "tokens"), lexicon, groups, vocabularies, lexicon_rows)
    listed = {n: {*words} for n, words in vocabularies.items()}
    known = lex.toArrow()
    valence = dict(zip(known["word"].to_pylist(), zip(known["n"].to_pylist(), known["v"].fill_null(0.0).to_pylist())))
    words = [*valence, *dict.fromkeys(w for ws in listed.values() for w in sorted(ws) if w not in valence)]
    met = [valence.get(w, (1, 0.0)) for w in words]
    table, _ = scan.word_finder()
    # The last of the values is that of words that are not there.
    times = np.array([*(n for n, _ in met), 1], np.int64)
    sent = (table(words), np.array([*(v for _, v in met), 0.0]), times if (times > 1).any() else None,
            {n: np.array([*(w in ws for w in words), False]) for n, ws in listed.items()})
    numbers = ["n_tokens", *listed, "valence"]
    rows = scan.text_counts(posts, keep, text, [*counts, *numbers], vocabularies, posts.sparkSession.sparkContext.broadcast(sent))
    # Repeated posts are one row, as their tokens are summed.
    return rows.withColumns(derived).groupBy(*groups).agg(*[F.sum(n).alias(n) for n in numbers[:-1]], tx.compound(F.sum("valence")).alias("sentiment"))


def frequent_words(tokenised: DataFrame, one_in: int = 50, words: int = FREQUENT_WORDS) -> DataFrame:
    """Tokens that stand twice or more in one post of ``one_in``, the most frequent ones; they steer joins, never results."""
    some = tokenised.filter(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select(F.explode("tokens").alias("token"))
    counts = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.orderBy(F.desc("n"), "token").limit(words).select("token")


def dealing(authors: DataFrame, posts_per_task: int = POSTS_PER_TASK) -> tuple[int, Column]:
    """Tasks for the posts of ``authors`` (a row a post), and whether an author has more of them than a task should count."""
    posts = materialize(authors.groupBy("author").agg(F.count(F.lit(1)).alias("n")), "author_posts")
    tasks = max(authors.sparkSession.sparkContext.defaultParallelism, -(-(posts.agg(F.sum("n")).first()[0] or 0) // posts_per_task))
    hot = [r["author"] for r in posts.filter((F.col("n") > posts_per_task) & F.col("author").isNotNull()).collect()]
    return tasks, F.coalesce(F.col("author").isin(hot), F.lit(False)) if hot else F.lit(False)


def counted(packed: DataFrame, tasks: int) -> DataFrame:
    """``(author, code, kinds)`` of packed rows. The rows of an author are read in a row where they arrive, so a task holds the distinct tokens of one author."""
    kind = packed.schema["author"].dataType.simpleString()
    dealt = packed.select("author", "_part", "codes", "_known", "_other").repartition(tasks, "author", "_part").sortWithinPartitions("author", "_part")
    return (dealt.mapInArrow(span_codes.counter(), f"author {kind}, code long, kinds long")
            .groupBy("author", "code").agg(F.sum("kinds").alias("kinds")))


def distinct_counts(marked: DataFrame, slices: int = SLICES, posts_per_task: int = POSTS_PER_TASK, words: list[str] | None = None) -> DataFrame:
    """``(author, code, kinds)``: how many different tokens the posts of each span of an author hold.

    ``marked`` has ``author, codes, tokens``: a post lies in all spans of its ``codes``. A post moves as one row: tokens that are among
    ``words`` as gaps between their sorted numbers, a byte or two each, the others as they are. Authors with more than
    ``posts_per_task`` posts are spread over ``slices`` rows by token; tasks follow the number of posts.
    """
    tasks, hot = dealing(marked, posts_per_task)
    kind = marked.schema["author"].dataType.simpleString()
    rows = marked.select("author", "codes", hot.alias("_hot"), "tokens")
    sent = marked.sparkSession.sparkContext.broadcast(words or [])
    return counted(rows.mapInArrow(span_codes.packer(sent, slices), f"author {kind}, {span_codes.PACKED}"), tasks)


def distinct_in_texts(posts: DataFrame, text: Column, spans: Callable[[DataFrame], DataFrame], words: list[str], slices: int = SLICES,
                      posts_per_task: int = POSTS_PER_TASK) -> DataFrame:
    """``distinct_counts`` of the tokens of ``text``, read from the bytes of many posts at once.

    ``spans`` turns ``(author, created_utc, ...)`` into the same rows with ``codes``. It is applied to packed posts, so no text meets a join for it.
    """
    spark = posts.sparkSession
    tasks, hot = dealing(spans(posts.select("author", "created_utc")), posts_per_task)
    table, _ = scan.word_finder()
    sent, classes = spark.sparkContext.broadcast((table(words), len(words))), spark.sparkContext.broadcast(scan.char_classes(spark))
    rows = posts.select("author", "created_utc", hot.alias("_hot"), F.concat(text, F.lit("\n")).alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    packed = rows.mapInArrow(span_codes.text_packer(classes, sent, slices), f"{kinds}, _part int, _known binary, _other string")
    return counted(spans(packed), tasks)


def post_facts(posts: DataFrame, lexicon: DataFrame, first_person=FIRST_PERSON, negative=NEGATIVE_WORDS) -> DataFrame:
    """One slim row per post with every number the linguistic windows need; the text is dropped."""
    sent_len = F.col("n_case") / F.nullif(F.col("n_sentences"), F.lit(0))
    return text_sums(posts, ["author", "id", "created_utc"], tx.compose("body", "title"), lexicon, {"n_first": first_person, "n_negative": negative},
                     ["n_case", "n_sentences"], {"sent_len": sent_len})


def window_frequency(n: Column, first: Column, last: Column, window: str, unit_days: int) -> Column:
    """Posts per unit. The baseline divides by its own span, at least one unit."""
    if window == "baseline":
        span = F.greatest(tm.day_span(first, last) / F.lit(float(unit_days)), F.lit(1.0))
        return F.when(n > 0, n / span).otherwise(0.0)
    return n / F.lit(float(PRE_WINDOWS[window]))


def window_aggregates(facts: DataFrame, unit_days: int) -> DataFrame:
    """All four windows in one pass of conditional sums, one row per author."""
    aggs = []
    for w, inside in tm.window_flags(F.col("age"), unit_days).items():
        def put(c, inside=inside):
            return F.when(inside, F.col(c))
        aggs += [
            F.count(F.when(inside, 1)).alias(f"n_{w}"), F.min(put("created_utc")).alias(f"lo_{w}"),
            F.max(put("created_utc")).alias(f"hi_{w}"), F.avg(put("sentiment")).alias(f"sentiment_mean_{w}"),
            F.avg(put("sent_len")).alias(f"avg_sent_len_{w}"), F.sum(put("n_tokens")).alias(f"tok_{w}"),
            F.sum(put("n_first")).alias(f"fp_{w}"), F.sum(put("n_negative")).alias(f"neg_{w}"),
        ]
    return facts.groupBy("author").agg(*aggs)


def with_spans(rows: DataFrame, labels: DataFrame, unit_days: int, windows: bool = True, buckets: bool = True) -> DataFrame:
    """Rows before the anchor with the ``codes`` of their spans: -1, -2 and on for windows, from 0 for baseline buckets."""
    u, age = tm.unit_micros(unit_days), F.col("age")
    codes = [F.when(inside, F.lit(-1 - i).cast("long")) for i, inside in enumerate(tm.window_flags(age, unit_days).values())] if windows else []
    codes += [F.when(age > 4 * u, tm.back_bucket(age - 4 * u, u))] if buckets else []
    return attach_age(rows, labels).filter(age > (0 if windows else 4 * u)).withColumn("codes", F.array_compact(F.array(*codes)))


def token_kinds(posts: DataFrame, labels: DataFrame, unit_days: int, windows: bool = True, buckets: bool = True) -> DataFrame:
    """``(author, code, kinds)``: distinct tokens per author of every window and baseline bucket, in one pass."""
    words = [r["token"] for r in materialize(frequent_words(post_tokens(posts)), "frequent_words").collect()]
    return distinct_in_texts(posts, tx.compose("body", "title"), lambda rows: with_spans(rows, labels, unit_days, windows, buckets), words)


def distinct_tokens(kinds: DataFrame) -> DataFrame:
    """Distinct tokens per author and window, a column each, from ``token_kinds``."""
    return kinds.filter("code < 0").groupBy("author").agg(
        *[F.max(F.when(F.col("code") == -1 - i, F.col("kinds"))).alias(f"distinct_{w}") for i, w in enumerate(WINDOWS)])


def linguistic_windows(posts: DataFrame, labels: DataFrame, lexicon: DataFrame, unit_days: int = UNIT_DAYS,
                       first_person=FIRST_PERSON, negative=NEGATIVE_WORDS) -> DataFrame:
    """Seven features for each of the four windows, one row per author."""
    return windows_from(*shared_facts(posts, labels, lexicon, unit_days, first_person, negative, buckets=False), unit_days)


def shared_facts(posts: DataFrame, labels: DataFrame, lexicon: DataFrame, unit_days: int = UNIT_DAYS, first_person=FIRST_PERSON,
                 negative=NEGATIVE_WORDS, windows: bool = True, buckets: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per-post facts with ages, and distinct tokens of all spans, each written once: windows and buckets are sums of the same slim rows,
    and the shuffles of one are gone from disk before the other begins."""
    facts = materialize(attach_age(post_facts(posts, lexicon, first_person, negative), labels), "post_facts")
    return facts, materialize(token_kinds(posts, labels, unit_days, windows, buckets), "token_kinds")


def windows_from(aged: DataFrame, kinds: DataFrame, unit_days: int) -> DataFrame:
    """The same from per-post facts with ages and ``token_kinds`` that are already there."""
    joined = window_aggregates(aged, unit_days).join(distinct_tokens(kinds), "author", "left")
    cols = []
    for w in WINDOWS:
        n, tok = F.col(f"n_{w}"), F.col(f"tok_{w}")
        cols += [
            F.col(f"sentiment_mean_{w}"),
            F.when(tok >= 2, F.col(f"distinct_{w}") / tok).alias(f"ttr_{w}"),
            F.col(f"avg_sent_len_{w}"),
            window_frequency(n, F.col(f"lo_{w}"), F.col(f"hi_{w}"), w, unit_days).alias(f"post_freq_{w}"),
            tx.safe_ratio(F.col(f"fp_{w}"), tok).alias(f"fp_pronoun_rate_{w}"),
            tx.safe_ratio(F.col(f"neg_{w}"), tok).alias(f"neg_affect_rate_{w}"),
            F.when(n > 0, tok / n).alias(f"avg_post_len_{w}"),
        ]
    return joined.select("author", *cols)


def add_deltas(wide: DataFrame, features: list[str]) -> DataFrame:
    """Pre-window minus baseline for every feature; null when either side is null."""
    return wide.select("*", *[(F.col(f"{f}_{w}") - F.col(f"{f}_baseline")).alias(f"{f}_delta_{w}")
                              for w in PRE_WINDOWS for f in features])


def raw_features(posts: DataFrame, labels: DataFrame, lexicon: DataFrame, unit_days: int = UNIT_DAYS, **lists) -> DataFrame:
    return add_deltas(linguistic_windows(posts, labels, lexicon, unit_days, **lists), LINGUISTIC)
