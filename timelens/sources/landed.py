"""Normalisers for landed JSON: posts and comments, multi-type blog posts, interactions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DELETED_MARKERS, PROVIDER_PATTERNS
from ..functions import text as tx
from ..functions import timefn as tm
from ..functions.scalar import joined, number, truthy, whole
from ..schema import INTERACTION, LANDED_BLOG_POST, LANDED_POST


def _filled(name: str) -> Column:
    """A text field, or null when it is missing or empty."""
    return F.nullif(F.col(name), F.lit(""))


def _time(name: str) -> Column:
    return tm.epoch_text_to_ntz(F.coalesce(_filled(name), F.lit("0")))


def _count(name: str) -> Column:
    return whole(F.coalesce(_filled(name), F.lit("0")))


def landed_rejects(raw: DataFrame, json_col: str = "value", time_field: str = "created_utc") -> DataFrame:
    """One row: lines read, lines that are no JSON object, and objects whose time is there but unreadable."""
    text = F.col(json_col)
    parsed = F.coalesce(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.lit(False))
    at = F.coalesce(F.nullif(F.get_json_object(text, f"$.{time_field}"), F.lit("")), F.lit("0"))
    bad_time = parsed & tm.epoch_text_to_ntz(at).isNull()
    return raw.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~parsed).alias("not_an_object"), F.count_if(bad_time).alias("bad_time"))


def landed_posts(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Posts and comments to the post schema: body from either field, zero for missing counts,
    null for a missing or zero vote ratio.

    Numbers may be whole, fractional or text. A missing time is the epoch; a time or count that is there and no number is
    null, never a made-up value (``landed_rejects`` counts such rows)."""
    item = raw.select(F.from_json(json_col, LANDED_POST).alias("j")).select("j.*")
    body = F.coalesce(_filled("selftext"), _filled("body"), F.lit(""))
    return item.select(
        F.coalesce("author", F.lit("")).alias("author"),
        F.when(body.isin(DELETED_MARKERS), "").otherwise(body).alias("body"),
        _time("created_utc").alias("created_utc"),
        F.coalesce("id", F.lit("")).alias("id"),
        _count("num_comments").alias("num_comments"), _count("score").alias("score"),
        F.coalesce("subreddit", F.lit("")).alias("subreddit"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.nullif(number(F.col("upvote_ratio")), F.lit(0.0)).alias("upvote_ratio"),
        F.coalesce(_filled("url"), _filled("permalink"), F.lit("")).alias("url"),
        F.lit(None).cast("double").alias("days_to_tp"))


def landed_blog_posts(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Text, quote, answer and chat posts to the post schema; other types and empty posts dropped."""
    item = raw.select(F.from_json(json_col, LANDED_BLOG_POST).alias("j")).select("j.*")

    def txt(name):
        return F.coalesce(name, F.lit(""))

    kind = F.col("type")
    chat = F.array_join(F.transform("dialogue", lambda d: F.coalesce(d["phrase"], F.lit(""))), " ")
    body = (F.when(kind == "text", txt("body"))
            .when(kind == "quote", F.concat(txt("text"), F.lit(" "), txt("source")))
            .when(kind == "answer", txt("answer"))
            .when(kind == "chat", F.coalesce(chat, F.lit(""))))
    title = (F.when(kind == "quote", F.lit("")).when(kind == "answer", txt("question")).otherwise(txt("title")))
    tags = F.coalesce(F.slice("tags", 1, 3), F.array().cast("array<string>"))
    return (item.filter(kind.isin("text", "quote", "answer", "chat"))
            .select("author", tx.strip(body).alias("body"),
                    _time("timestamp").alias("created_utc"),
                    F.coalesce("id", F.lit("")).alias("id"),
                    _count("reply_count").alias("num_comments"), _count("note_count").alias("score"),
                    F.concat(F.lit("tumblr:"), F.array_join(tags, ",")).alias("subreddit"),
                    tx.strip(title).alias("title"), F.lit(None).cast("double").alias("upvote_ratio"),
                    F.coalesce("post_url", F.lit("")).alias("url"), F.lit(None).cast("double").alias("days_to_tp"))
            .filter((F.length("body") > 0) | (F.length("title") > 0)))


def read_interactions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested interaction records with an explicit schema (no inference pass)."""
    return with_defaults(spark.read.schema(INTERACTION).json(path, multiLine=multi_line))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Missing members take the values the features expect."""
    f = F.col("filters")
    return raw.select(
        "ts", F.coalesce("type", F.lit("view")).alias("type"), F.coalesce("providerId", F.lit("")).alias("provider_id"),
        number(F.col("score")).alias("score"), number(F.col("rating")).alias("rating"),
        *[truthy(F.col(c)).alias(c) for c in ("insuranceMatch", "insurancePartial", "ageMatch", "telehealthMatch", "languageMatch", "genderMatch")],
        *[F.coalesce(number(F.col(c)), F.lit(0.5)).alias(c) for c in ("concernsOverlap", "modalityOverlap", "culturalOverlap")],
        F.coalesce(f["insurance"], F.lit("any")).alias("insurance"),
        f["ageGroup"].alias("age_group"),
        F.coalesce(f["urgency"], F.lit("exploring")).alias("urgency"),
        f["insurance"].alias("insurance_given"), f["urgency"].alias("urgency_given"))


# Column titles of the flat interaction table (fixed values).
FLAT_FILTERS = ["zip", "insurance", "ageGroup", "telehealth", "urgency", "sessionFormat", "language", "providerGender"]
FLAT_LISTS = ["concerns", "modalities", "cultural", "accessibility"]


def flatten_interactions(raw: DataFrame, json_col: str = "value", now: Column | None = None) -> DataFrame:
    """One flat row of 18 columns per payload; lists joined by ', ', a list given as text kept as it is; numbers as they were
    written; missing values empty."""
    parsed = raw.select(F.from_json(json_col, INTERACTION).alias("j"), F.col(json_col).alias("raw_json"))
    j, f = F.col("j"), F.col("j.filters")
    stamp = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return parsed.select(
        F.coalesce(F.nullif(j["ts"], F.lit("")), stamp).alias("timestamp"),
        F.coalesce(j["type"], F.lit("")).alias("type"), F.coalesce(j["providerId"], F.lit("")).alias("provider_id"),
        F.coalesce(j["rating"], F.lit("")).alias("rating"),
        F.coalesce(j["score"], F.lit("")).alias("score"),
        *[F.coalesce(f[c], F.lit("")).alias(c) for c in FLAT_FILTERS],
        *[F.coalesce(joined(f[c]), F.lit("")).alias(c) for c in FLAT_LISTS],
        "raw_json")


def entity_flags(pages: DataFrame, text_col: str, id_pattern: str, opening: tuple[str, str], block_end: str,
                 patterns: dict[str, str] | None = None) -> DataFrame:
    """Entities named inside pages, with one boolean per pattern searched in the entity's block.

    A block starts at the first ``opening[0] + id + opening[1]`` of its page and runs to the
    next ``block_end``; without an end it is empty. Blocks are cut and searched inside the
    page's own row: only ids and flags are exploded, never text.
    """
    patterns = patterns or PROVIDER_PATTERNS
    keys = [c for c in pages.columns if c != text_col]
    text = F.col(text_col)
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(id_pattern), F.lit(1)))

    def block(entity: Column) -> Column:
        rest = F.substr(text, F.position(F.concat(F.lit(opening[0]), entity, F.lit(opening[1])), text))
        end = F.instr(rest, block_end)
        return F.when(end > 1, F.substr(rest, F.lit(1), end - 1)).otherwise("")

    blocks = F.transform(ids, lambda e: F.struct(e.alias("entity"), block(e).alias("block")))
    flags = F.transform(blocks, lambda b: F.struct(b["entity"].alias("entity"), *[b["block"].rlike(p).alias(n) for n, p in patterns.items()]))
    return pages.select(*keys, F.inline(flags))
