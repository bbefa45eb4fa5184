"""Views that give the shared test tables the shapes the operators read, in Spark and in SQL.

Every view keeps all rows and whole texts. ``UNIT`` is one day because the event table
spans thirty days; the library default is seven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AGE_OPTIONS, INSURANCE_OPTIONS, PROVIDER_FLAGS, URGENCY_OPTIONS
from ..functions import text as tx
from ..operators.turning_point import LabelRules, label_users
from ..session import materialize

UNIT = 1
RULES = LabelRules(crisis=["error severe", "error extreme"], recovery=["purchase severe", "purchase extreme"],
                   ambiguous=["purchase severe"], unit_days=UNIT)
FIRST = ["on", "in", "it", "is"]
NEGATIVE = ["the", "and", "of", "with"]
WE = ["an", "at", "as"]
YOU = ["to", "by", "or"]
LISTS = {"first_person": FIRST, "negative": NEGATIVE}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer splits than the session has slots.

    A small file is read by one task, and the text work after it would then run in one task
    too. Large inputs have enough splits and pass through without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def row_count(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts; the body is the whole text of a document."""
    source = table(spark, sf, "documents").select("doc_id", "text")
    docs = widen(source, "doc_id")
    ev = widen(table(spark, sf, "events"), "event_id")
    v = F.col("value")
    return (ev.withColumn("doc_id", F.pmod("event_id", row_count(source))).join(docs, "doc_id")
            .select(F.concat(F.lit("u"), "user_id").alias("author"), F.concat(F.lit("e"), "event_id").alias("id"),
                    F.col("ts").alias("created_utc"), F.col("event_type").alias("subreddit"),
                    F.concat("event_type", F.when(v > 200, " extreme").when(v > 120, " severe").otherwise("")).alias("title"),
                    F.col("text").alias("body"), F.floor("value").alias("score")))


_TABLES: dict = {}


def once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A table written once per session and input, then read by every later job.

    Spark then knows its real size and broadcasts it only when that is small.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(make(), name)
    return _TABLES[key]


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    return label_users(posts(spark, sf), RULES)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label table as the feature jobs see it: the written result of the labelling job."""
    return once(spark, sf, "labels", lambda: label_table(spark, sf))


def dirty_posts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("id", 2, 20).cast("long")
    return (posts(spark, sf)
            .withColumn("author", F.when(n % 19 == 0, "[removed]").otherwise(F.col("author")))
            .withColumn("body", F.when(n % 23 == 0, "   ").when(n % 17 == 0, "[deleted]").otherwise(F.col("body")))
            .withColumn("created_utc", F.when(n % 29 != 0, F.col("created_utc"))))


def orders_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("author"), F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_utc"), F.col("o_orderpriority").alias("title"),
        F.col("o_totalprice").alias("total"))


def conversation_posts(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("author"), F.concat_ws("_", "conv_id", "turn").alias("id"),
        (start + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("created_utc"),
        F.col("role").alias("subreddit"), F.col("role").alias("title"), F.col("text").alias("body"),
        F.length("text").cast("long").alias("score"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Token valence by rule: ``length % 9 - 4``, zero left out; written once."""
    return once(spark, sf, "lexicon", lambda: lexicon_table(spark, sf))


def lexicon_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = widen(table(spark, sf, "documents"), "doc_id").select(F.explode(tx.tokens("text")).alias("word"))
    kinds = table(spark, sf, "events").select(F.explode(tx.tokens("event_type")).alias("word"))
    extra = spark.createDataFrame([("severe",), ("extreme",)], "word string")
    return (docs.unionByName(kinds).unionByName(extra).distinct()
            .withColumn("valence", F.length("word") % 9 - 4).filter("valence <> 0"))


def post_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Post id to vector."""
    emb = table(spark, sf, "embeddings")
    ev = widen(table(spark, sf, "events"), "event_id").withColumn("vec_id", F.pmod("event_id", row_count(emb)))
    return ev.join(emb, "vec_id").select(F.concat(F.lit("e"), "event_id").alias("id"), "embedding")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled class scores ``(id, label, fold, class, score)`` with many ties, from events."""
    ev = widen(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    label = (F.when(F.col("event_type") == "error", "crisis").when(F.col("event_type") == "purchase", "recovery")
             .otherwise("neither"))
    k = F.col("event_id")
    return ev.select(k.alias("id"), label.alias("label"), (k % 5).alias("fold"), cents.alias("cents"),
                     F.expr("stack(3, 'crisis', 7, 'recovery', 11, 'neither', 3) as (class, m)")).select(
        "id", "label", "fold", "class", (((F.col("cents") + F.when(F.col("label") == F.col("class"), 60).otherwise(0))
                                          * F.col("m")) % 997 / 1000.0).alias("score"))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as flat interactions with a label and a predicted score."""
    from ..operators.match import labelled
    e = F.col("event_id")
    ins = F.array(*[F.lit(x) for x in INSURANCE_OPTIONS])
    ages = F.array(*[F.lit(x) for x in AGE_OPTIONS])
    urg = F.array(*[F.lit(x) for x in URGENCY_OPTIONS])
    kind = (F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "website")
            .when(F.col("event_type") == "purchase", "call").when(F.col("event_type") == "signup", "rate").otherwise("view"))
    ev = widen(table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "ts"), "event_id")
    flags = {n: e % k == 0 for n, k in zip(("insuranceMatch", "insurancePartial", "ageMatch", "telehealthMatch",
                                            "languageMatch", "genderMatch"), (2, 3, 5, 7, 11, 13))}
    return labelled(ev.select(
        e.alias("id"), F.col("user_id").alias("group"), "ts", kind.alias("type"), F.floor("value").alias("score"),
        F.when(kind == "rate", 1 + F.floor("value") % 5).alias("rating"),
        F.pmod(e, row_count(table(spark, sf, "supplier"))).alias("provider_id"),
        F.element_at(ins, (e % 8 + 1).cast("int")).alias("insurance"), F.element_at(ages, (e % 4 + 1).cast("int")).alias("age_group"),
        F.element_at(urg, (F.floor(e / 8) % 4 + 1).cast("int")).alias("urgency"),
        *[c.alias(n) for n, c in flags.items()], ((e % 5) / 4).alias("concernsOverlap"), ((e % 4) / 3).alias("modalityOverlap"),
        ((e % 3) / 2).alias("culturalOverlap"), (F.col("value") / 500).alias("p"))
        .withColumn("insurance_given", F.col("insurance")).withColumn("urgency_given", F.col("urgency")))


def providers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("provider_id"),
                    *[(F.col("s_nationkey") % k == 0).alias(n) for n, k in zip(PROVIDER_FLAGS, range(2, 11))])


# ---------------------------------------------------------------- SQL side
POSTS = """posts AS (
  SELECT concat('u', user_id) AS author, concat('e', event_id) AS id, ts AS created_utc, event_type AS subreddit,
         event_type || CASE WHEN value > 200 THEN ' extreme' WHEN value > 120 THEN ' severe' ELSE '' END AS title,
         d.text AS body, CAST(floor(value) AS BIGINT) AS score, event_id
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""

# needs a CTE named posts; labels every active author
LABELS = """m AS (
  SELECT *, CASE WHEN regexp_matches(coalesce(title,'') || ' ' || coalesce(body,''), '(?i)error severe|error extreme')
                 THEN 'crisis'
                 WHEN regexp_matches(coalesce(title,'') || ' ' || coalesce(body,''), '(?i)purchase severe|purchase extreme')
                 THEN 'recovery' END AS lab
  FROM posts),
tp AS (
  SELECT author, lab, created_utc AS tp_ts, id AS tp_id, subreddit AS tp_sub,
         regexp_extract(coalesce(title,'') || ' ' || coalesce(body,''),
           CASE WHEN lab = 'crisis' THEN '(?i)(error severe|error extreme)' ELSE '(?i)(purchase severe|purchase extreme)' END, 1) AS phrase
  FROM m WHERE lab IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY author ORDER BY created_utc, id) = 1),
span AS (
  SELECT author, count(*) AS n_posts, min(created_utc) AS first_ts, max(created_utc) AS last_ts
  FROM posts GROUP BY author HAVING count(*) > 10),
lab0 AS (
  SELECT s.*, t.*, coalesce(s.first_ts < t.tp_ts - INTERVAL 4 DAY, false) AS ok
  FROM span s LEFT JOIN (SELECT author AS a2, * EXCLUDE (author) FROM tp) t ON s.author = t.a2),
labels_t AS (
  SELECT author, CASE WHEN ok THEN lab ELSE 'neither' END AS label, n_posts,
         CASE WHEN ok THEN tp_id END AS tp_post_id, CASE WHEN ok THEN tp_ts END AS tp_date,
         CASE WHEN ok THEN tp_sub END AS tp_subreddit, CASE WHEN ok THEN phrase END AS tp_matched_phrase,
         first_ts, last_ts, coalesce(ok AND lower(phrase) = 'purchase severe', false) AS low_confidence,
         CASE WHEN ok THEN tp_ts ELSE last_ts END AS anchor
  FROM lab0)"""

AGED = """aged AS (
  SELECT p.*, l.anchor, date_diff('microsecond', p.created_utc, l.anchor) AS age
  FROM posts p JOIN labels_t l USING (author)),
win AS (SELECT * FROM (VALUES ('baseline', 4, 1000000), ('pre_4w', 0, 4), ('pre_2w', 0, 2), ('pre_1w', 0, 1)) w(w, lo, hi)),
inwin AS (SELECT a.*, win.w FROM aged a JOIN win ON a.age > lo * 86400000000 AND a.age <= hi * 86400000000)"""

# Word characters outside ASCII become '_' so that ASCII word borders agree with Unicode ones.
def fold(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]|[^\\x00-\\x7F\\P{{M}}]', '_', 'g')"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({fold(f'lower({expr})')}, '\\b[a-z'']+\\b')"


def words_sql(expr: str) -> str:
    return f"regexp_extract_all({fold(expr)}, '\\b[A-Za-z'']+\\b')"


def case_tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({fold(expr)}, '\\b[a-z'']+\\b')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sentences_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array({expr}, '[.!?]+'), "
            f"lambda s: length(regexp_replace(s, '[\\s\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+', '', 'g')) > 0)")


TEXT = "(coalesce(body,'') || ' ' || coalesce(title,''))"

FACTS = f"""toks AS (
  SELECT author, id, created_utc, {TEXT} AS text, {tokens_sql(TEXT)} AS tokens FROM posts),
facts AS (
  SELECT author, id, created_utc, text, tokens, len(tokens) AS n_tokens,
         len(list_filter(tokens, lambda t: t IN {in_list(FIRST)})) AS n_first,
         len(list_filter(tokens, lambda t: t IN {in_list(NEGATIVE)})) AS n_negative,
         CASE WHEN len({sentences_sql('text')}) > 0
              THEN len({case_tokens_sql('text')})::DOUBLE / len({sentences_sql('text')}) END AS sent_len,
         coalesce(list_sum(list_transform(tokens, lambda t: length(t) % 9 - 4)), 0)::DOUBLE AS val
  FROM toks),
scored AS (SELECT *, val / sqrt(val * val + 15.0) AS sentiment FROM facts)"""


SCORES = """sc0 AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'crisis' WHEN 'purchase' THEN 'recovery' ELSE 'neither' END AS label,
  event_id % 5 AS fold, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
scores AS (SELECT id, label, fold, c.cls AS "class", (((cents + CASE WHEN label = c.cls THEN 60 ELSE 0 END) * c.m) % 997) / 1000.0::DOUBLE AS score
  FROM sc0, (VALUES ('crisis', 7), ('recovery', 11), ('neither', 3)) c(cls, m)),
preds AS (SELECT id, label, fold, arg_min("class", (-score, "class")) AS prediction FROM scores GROUP BY ALL)"""

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

INTERACTIONS = f"""ix0 AS (SELECT event_id AS id, user_id AS grp, ts, value,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'website' WHEN 'purchase' THEN 'call' WHEN 'signup' THEN 'rate' ELSE 'view' END AS type,
  CAST(floor(value) AS BIGINT) AS score, event_id % (SELECT count(*) FROM supplier) AS provider_id,
  ({_LIST(INSURANCE_OPTIONS)})[event_id % 8 + 1] AS insurance, ({_LIST(AGE_OPTIONS)})[event_id % 4 + 1] AS age_group,
  ({_LIST(URGENCY_OPTIONS)})[(event_id // 8) % 4 + 1] AS urgency, value / 500 AS p FROM events),
ix1 AS (SELECT *, CASE WHEN type = 'rate' THEN 1 + score % 5 END AS rating FROM ix0),
ix AS (SELECT *, CASE WHEN rating IS NOT NULL THEN (rating - 1) / 4.0 WHEN type = 'call' THEN 1.0 WHEN type = 'website' THEN 0.6 ELSE 0.3 END::DOUBLE AS y FROM ix1),
prov AS (SELECT s_suppkey AS provider_id, {', '.join(f"s_nationkey % {k} = 0 AS {n}" for n, k in zip(PROVIDER_FLAGS, range(2, 11)))} FROM supplier)"""
