"""Source, sink, normaliser and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import landed, merge, tables
from ..sources.keyed import KeyedTable
from . import views as v
from .registry import query
from .timeline import DIRTY
from .views import LABELS, POSTS


@query("scan_columns", "A1", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "o_totalprice")
def q_scan(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("parquet_overwrite", "A2", "SELECT event_id, user_id, ts, event_type, value FROM events", "value")
def q_write(spark, sf):
    path = shared_dir(spark, "events")
    ev = v.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    tables.write_table(ev.filter("event_id < 0"), path, ["event_type"])
    tables.write_table(ev, path, ["event_type"])
    return tables.read_table(spark, path).select(*ev.columns)


@query("append_keep_first", "A3 C10", f"""WITH {DIRTY},
batch AS (SELECT id, title, created_utc, 'late' AS origin FROM dirty WHERE event_id_d % 2 = 0 OR event_id_d % 3 = 0),
have AS (SELECT id, title, created_utc, 'early' AS origin FROM posts WHERE score >= 40)
SELECT * FROM have UNION ALL
SELECT id, title, created_utc, origin FROM batch WHERE id NOT IN (SELECT id FROM have)""".replace(
    "subreddit, title, score FROM posts)", "subreddit, title, score, event_id AS event_id_d FROM posts)"))
def q_append(spark, sf):
    """Existing rows are posts with a score of 40 or more; the batch repeats many of them."""
    n = F.substring("id", 2, 20).cast("long")
    cols = ["id", "title", "created_utc", "origin"]
    have = v.posts(spark, sf).filter("score >= 40").withColumn("origin", F.lit("early")).select(*cols)
    batch = v.dirty_posts(spark, sf).filter((n % 2 == 0) | (n % 3 == 0)).withColumn("origin", F.lit("late")).select(*cols)
    twice = batch.unionByName(batch)
    return tables.append_keep_first(have, twice, "id", [F.col("created_utc"), F.col("title")])


@query("keyed_table_append", "A3 C10", f"""WITH {DIRTY},
have AS (SELECT id, title, created_utc, 'early' AS origin FROM posts WHERE score >= 40)
SELECT * FROM have UNION ALL SELECT id, title, created_utc, 'late' FROM dirty WHERE id NOT IN (SELECT id FROM have)""")
def q_keyed(spark, sf):
    """Three appends to one keyed table: high scores, then every landed post twice; what was there first stays."""
    cols = ["id", "title", "created_utc"]
    early = v.posts(spark, sf).filter("score >= 40").select(*cols, F.lit("early").alias("origin"))
    late = v.dirty_posts(spark, sf).select(*cols, F.lit("late").alias("origin"))
    table = KeyedTable(spark, shared_dir(spark, "keyed"), late.schema, "id", split_rows=100_000)
    for batch in (early, late, late):
        table.append(batch, [F.col("created_utc"), F.col("title")])
    return table.read()


def with_members(json, **tokens):
    """``json`` (text of an object) with more members, whose values are JSON text; a null token adds nothing."""
    more = [F.concat(F.lit(f',"{name}":'), token) for name, token in tokens.items()]
    return F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format(json)), F.concat_ws("", *more), F.lit("}"))


def spelled(text, how):
    """Number text as a JSON number or, where ``how`` holds, as a JSON string."""
    return F.when(how, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def interaction_json(spark, sf):
    """Events as nested interaction payloads: members left out, fractional numbers, numbers as text, lists as plain text."""
    e = F.col("event_id")
    ins = F.array(*[F.lit(x) for x in ("medicaid", "medicare", "bcbs", "cigna", "aetna", "uhc", "uninsured", "sliding_scale")])
    ages = F.array(*[F.lit(x) for x in ("child", "teen", "adult", "senior")])
    urg = F.array(*[F.lit(x) for x in ("crisis", "urgent", "routine", "exploring")])
    filters = F.to_json(F.struct(
        F.when(e % 9 != 0, F.element_at(ins, (e % 8 + 1).cast("int"))).alias("insurance"),
        F.element_at(ages, (e % 4 + 1).cast("int")).alias("ageGroup"),
        F.when(e % 10 != 0, F.element_at(urg, ((F.floor(e / 8)) % 4 + 1).cast("int"))).alias("urgency")))
    concerns = (F.when(e % 6 == 0, '"anxiety, grief"').when(e % 3 == 0, '["anxiety","grief"]').when(e % 6 == 1, '"ocd"').when(e % 3 == 1, '["ocd"]'))
    rest = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("type"),
        F.concat(F.lit("p"), e % 100).alias("providerId"), F.when(e % 5 != 0, e % 2 == 0).alias("insuranceMatch")))
    half = F.when(e % 2 == 0, 0.5).otherwise(0.0)
    score = (F.floor("value") + half).cast("string")
    rating = F.when(F.col("event_type") == "signup", (1 + F.floor("value") % 4 + half).cast("string"))
    overlap = F.when(e % 7 != 0, ((e % 5) / 4).cast("string"))
    raw = v.table(spark, sf, "events").withColumn("_filters", filters).withColumn("_rest", rest)
    value = with_members("_rest", score=spelled(score, e % 3 == 0), rating=spelled(rating, e % 4 == 1), concernsOverlap=spelled(overlap, e % 8 == 3),
                         filters=with_members("_filters", concerns=concerns))
    return raw.select("event_id", value.alias("value"))


INTER = """inter AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS type, concat('p', event_id % 100) AS pid,
  floor(value) + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS score,
  CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE + CAST(floor(value) AS BIGINT) % 4 + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.0 END END AS rating,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 END AS im, CASE WHEN event_id % 7 <> 0 THEN (event_id % 5) / 4.0 END AS co,
  CASE WHEN event_id % 9 <> 0 THEN ['medicaid','medicare','bcbs','cigna','aetna','uhc','uninsured','sliding_scale'][event_id % 8 + 1] END AS ins,
  ['child','teen','adult','senior'][event_id % 4 + 1] AS age,
  CASE WHEN event_id % 10 <> 0 THEN ['crisis','urgent','routine','exploring'][(event_id // 8) % 4 + 1] END AS urg,
  CASE WHEN event_id % 3 = 0 THEN 'anxiety, grief' WHEN event_id % 3 = 1 THEN 'ocd' ELSE '' END AS concerns FROM events)"""


@query("interactions_json_scan", "A4 H20", f"""WITH {INTER}
SELECT ts, type, pid AS provider_id, score, rating, coalesce(im, false) AS insurance_match, coalesce(co, 0.5) AS concerns_overlap,
  0.5 AS modality_overlap, coalesce(ins, 'any') AS insurance, age AS age_group, coalesce(urg, 'exploring') AS urgency FROM inter""",
       "score rating concerns_overlap modality_overlap")
def q_json(spark, sf):
    path = shared_dir(spark, "interactions")
    interaction_json(spark, sf).select("value").write.mode("overwrite").text(path)
    return landed.read_interactions(spark, path).select(
        "ts", "type", "provider_id", "score", "rating", F.col("insuranceMatch").alias("insurance_match"),
        F.col("concernsOverlap").alias("concerns_overlap"), F.col("modalityOverlap").alias("modality_overlap"),
        "insurance", "age_group", "urgency")


@query("interactions_flat", "A10", f"""WITH {INTER}
SELECT ts AS "timestamp", type, pid AS provider_id, coalesce(CAST(CAST(rating AS DOUBLE) AS VARCHAR), '') AS rating, CAST(CAST(score AS DOUBLE) AS VARCHAR) AS score,
  '' AS zip, coalesce(ins, '') AS insurance, age AS "ageGroup", '' AS telehealth, coalesce(urg, '') AS urgency, '' AS "sessionFormat",
  '' AS language, '' AS "providerGender", concerns, '' AS modalities, '' AS cultural, '' AS accessibility, true AS has_raw FROM inter""")
def q_flat(spark, sf):
    flat = landed.flatten_interactions(interaction_json(spark, sf))
    return flat.withColumn("has_raw", F.length("raw_json") > 0).drop("raw_json")


LANDED_TIME = """CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '1970-01-01' WHEN event_id % 5 = 4 THEN NULL
  WHEN event_id % 5 = 3 THEN date_trunc('second', created_utc) + INTERVAL 500 MILLISECOND ELSE date_trunc('second', created_utc) END"""


def landed_time(n):
    """Epoch seconds as a whole, fractional or text number, as junk, or left out (null)."""
    whole = F.unix_timestamp("created_utc").cast("string")
    token = (F.when(n % 5 == 0, whole).when(n % 5 == 1, F.concat(whole, F.lit(".0"))).when(n % 5 == 2, F.concat(F.lit('"'), whole, F.lit('"')))
             .when(n % 5 == 3, F.concat(F.lit('"'), whole, F.lit('.5"'))).otherwise('"soon"'))
    return F.when(n % 11 != 0, token)


def landed_score(n):
    text = F.col("score").cast("string")
    return F.when(n % 3 == 0, text).when(n % 3 == 1, F.concat(text, F.lit(".0"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


@query("landed_posts", "A6 H12", f"""WITH {POSTS}
SELECT author, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 4 = 0 THEN title ELSE body END AS body,
  {LANDED_TIME} AS created_utc, id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 6 END AS num_comments, score,
  subreddit, CASE WHEN event_id % 4 = 0 THEN '' ELSE title END AS title,
  CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE (event_id % 5) / 4.0 END AS upvote_ratio,
  CASE WHEN event_id % 3 = 0 THEN 'https://a/' || id WHEN event_id % 3 = 1 THEN '/r/' || id ELSE '' END AS url FROM posts""",
       "upvote_ratio")
def q_landed(spark, sf):
    """Half posts, half comments, whole bodies; deleted bodies, zero ratios, missing links and every spelling of numbers included."""
    return landed.landed_posts(landed_raw(spark, sf)).drop("days_to_tp")


def landed_raw(spark, sf):
    n = F.substring("id", 2, 20).cast("long")
    comment = n % 4 == 0
    text = F.when(n % 17 == 0, "[deleted]").when(comment, F.col("title")).otherwise(F.col("body"))
    rest = F.to_json(F.struct(
        "author", F.when(~comment, text).otherwise("").alias("selftext"), F.when(comment, text).alias("body"),
        "id", F.when(n % 6 != 0, n % 6).alias("num_comments"), "subreddit", F.when(~comment, F.col("title")).alias("title"),
        F.when(n % 3 == 0, F.concat(F.lit("https://a/"), "id")).otherwise("").alias("url"),
        F.when(n % 3 == 1, F.concat(F.lit("/r/"), "id")).alias("permalink")))
    ratio = F.when(n % 5 == 0, "0.0").when(n % 5 > 1, ((n % 5) / 4).cast("string"))
    value = with_members("_rest", created_utc=landed_time(n), score=landed_score(n), upvote_ratio=spelled(ratio, n % 2 == 0))
    return v.posts(spark, sf).withColumn("_rest", rest).select(value.alias("value"))


@query("landed_rejects", "A6", f"""WITH {POSTS}
SELECT count(*) + count(*) FILTER (event_id % 7 = 0) AS lines, count(*) FILTER (event_id % 7 = 0) AS not_an_object,
  count(*) FILTER (event_id % 11 <> 0 AND event_id % 5 = 4) AS bad_time FROM posts""")
def q_landed_rejects(spark, sf):
    """Lines that cannot be read, next to the good ones."""
    raw = landed_raw(spark, sf)
    n = F.substring(F.get_json_object("value", "$.id"), 2, 20).cast("long")
    broken = raw.where(n % 7 == 0).select(F.when(n % 2 == 0, F.concat(F.lit("{oops "), "value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))).alias("value"))
    return landed.landed_rejects(raw.unionByName(broken))


@query("landed_blog_posts", "A7", f"""WITH {POSTS},
b AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'quote' WHEN 2 THEN 'answer' WHEN 3 THEN 'chat' ELSE 'photo' END AS kind FROM posts),
c AS (SELECT author, id, {LANDED_TIME} AS created_utc, kind, event_id, subreddit, score,
  CASE kind WHEN 'text' THEN CASE WHEN event_id % 15 = 0 THEN '' ELSE regexp_replace(body, '^\\s+|\\s+$', '', 'g') END
     WHEN 'quote' THEN trim(title || ' ' || CASE WHEN event_id % 2 = 0 THEN 'src' ELSE '' END)
     WHEN 'answer' THEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') WHEN 'chat' THEN title || ' ' || subreddit END AS body,
  CASE kind WHEN 'quote' THEN '' WHEN 'answer' THEN 'why ' || subreddit WHEN 'text' THEN '' ELSE title END AS title FROM b WHERE kind <> 'photo')
SELECT author, body, created_utc, id, 0 AS num_comments, score,
  'tumblr:' || subreddit || ',b,c' AS subreddit, title, 'u/' || id AS url FROM c WHERE length(body) > 0 OR length(title) > 0""")
def q_blog(spark, sf):
    n = F.substring("id", 2, 20).cast("long")
    kinds = F.array(*[F.lit(k) for k in ("text", "quote", "answer", "chat", "photo")])
    kind = F.element_at(kinds, (n % 5 + 1).cast("int"))
    rest = F.to_json(F.struct(
        "author", F.col("kind").alias("type"), F.when((F.col("kind") == "text") & (n % 15 != 0), F.col("body")).alias("body"),
        F.when(F.col("kind") == "chat", F.col("title")).alias("title"), F.when(F.col("kind") == "quote", F.col("title")).alias("text"),
        F.when(n % 2 == 0, "src").alias("source"), F.when(F.col("kind") == "answer", F.col("body")).alias("answer"),
        F.concat(F.lit("why "), "subreddit").alias("question"),
        F.array(F.struct(F.col("title").alias("phrase")), F.struct(F.col("subreddit").alias("phrase"))).alias("dialogue"), "id",
        F.array(F.col("subreddit"), F.lit("b"), F.lit("c"), F.lit("d")).alias("tags"),
        F.concat(F.lit("u/"), "id").alias("post_url")))
    value = with_members("_rest", timestamp=landed_time(n), note_count=landed_score(n))
    raw = v.posts(spark, sf).withColumn("kind", kind).withColumn("_rest", rest).select(value.alias("value"))
    return landed.landed_blog_posts(raw).drop("upvote_ratio", "days_to_tp")


@query("embedding_store", "A8", """
SELECT concat('e', event_id) AS id, i.i - 1 AS dim, embedding[i.i]::DOUBLE AS x
FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings), range(1, 65) i(i)""", "x")
def q_emb(spark, sf):
    path = shared_dir(spark, "vectors")
    tables.save_embeddings(v.post_embeddings(spark, sf), path)
    return (tables.load_embeddings(spark, path).select("id", F.posexplode("embedding").alias("dim", "x"))
            .select("id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x")))


@query("user_list_semi", "A9 C9", f"""WITH {POSTS},
names AS (SELECT DISTINCT author FROM posts WHERE score % 5 <> 0 OR score % 7 <> 0)
SELECT author, count(*) AS n FROM posts WHERE author IN (SELECT author FROM posts WHERE score > 150) GROUP BY author""")
def q_users(spark, sf):
    """A name list with blanks, padding and comments, then the posts of the named users."""
    path = shared_dir(spark, "names")
    posts = v.posts(spark, sf)
    lines = posts.select(F.when(F.col("score") > 150, F.concat(F.lit("  "), "author", F.lit(" ")))
                         .when(F.col("score") % 2 == 0, "   ").otherwise(F.concat(F.lit("#"), "author")).alias("value"))
    lines.write.mode("overwrite").text(path)
    from ..operators.clean import keep_authors
    return keep_authors(posts, tables.read_user_list(spark, path)).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


@query("entity_flags", "A12", r"""
WITH ids AS (SELECT page_id, html, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]+)">', 1))) AS entity FROM pages),
r AS (SELECT page_id, entity, substr(html, instr(html, '<a href="' || entity || '">')) AS rest FROM ids),
b AS (SELECT page_id, entity, CASE WHEN instr(rest, '</li>') > 1 THEN substr(rest, 1, instr(rest, '</li>') - 1) ELSE '' END AS block FROM r)
SELECT page_id, entity, regexp_matches(block, 'tion') AS is_cmhc, regexp_matches(block, '>[A-Z]') AS is_fqhc, regexp_matches(block, 'the') AS is_crisis_center,
  regexp_matches(block, 'and') AS accepts_medicaid, regexp_matches(block, 'ing') AS accepts_uninsured, regexp_matches(block, 'er\s*<') AS has_telehealth,
  regexp_matches(block, 'ed<') AS has_crisis, regexp_matches(block, ',<') AS evening_hours, regexp_matches(block, 'wh') AS walk_in FROM b""")
def q_entities(spark, sf):
    patterns = {"is_cmhc": "tion", "is_fqhc": ">[A-Z]", "is_crisis_center": "the", "accepts_medicaid": "and",
                "accepts_uninsured": "ing", "has_telehealth": r"er\s*<", "has_crisis": "ed<", "evening_hours": ",<", "walk_in": "wh"}
    pages = v.widen(v.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return landed.entity_flags(pages, "html", '<a href="([^"]+)">', ('<a href="', '">'), "</li>", patterns)


CONV = """conv AS (SELECT concat('c', conv_id) AS author, concat_ws('_', conv_id, turn) AS id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INTEGER)) AS created_utc, role AS subreddit, text AS body FROM conversations)"""


@query("source_union", "G1", f"""WITH {POSTS}, {CONV}
SELECT source, author, count(*) AS posts, CAST(sum(length(body)) AS BIGINT) AS chars, count(score) AS scored FROM (
  SELECT 'first' AS source, author, body, score FROM posts UNION ALL SELECT 'second', author, body, NULL FROM conv) GROUP BY 1, 2""")
def q_union(spark, sf):
    posts, conv = v.posts(spark, sf), v.conversation_posts(spark, sf).drop("score")
    labels = v.labels(spark, sf).select("author", "label")
    conv_labels = conv.select("author").distinct().withColumn("label", F.lit("neither"))
    merged, _ = merge.union_sources([("first", posts, labels), ("skipped", posts, None), ("second", conv, conv_labels)])
    return merged.groupBy("source", "author").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.length("body")).alias("chars"),
                                                  F.count("score").alias("scored"))


@query("source_merge_first_wins", "G2", f"""WITH {DIRTY}, {CONV},
u AS (SELECT id, author, created_utc, 'first' AS source, 0 AS p FROM posts WHERE score >= 30
      UNION ALL SELECT id, author, created_utc, 'second', 1 FROM dirty
      UNION ALL SELECT id, author, created_utc, 'third', 2 FROM conv)
SELECT id, author, created_utc, source FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, created_utc) = 1""")
def q_merge(spark, sf):
    cols = ["id", "author", "created_utc"]
    one = v.posts(spark, sf).filter("score >= 30").select(*cols)
    two, three = v.dirty_posts(spark, sf).select(*cols), v.conversation_posts(spark, sf).select(*cols)
    people = one.select("author").distinct().withColumn("label", F.lit("neither"))
    posts, _ = merge.merge_sources([("first", one, people), ("second", two, people), ("third", three, people)])
    return posts.select("id", "author", "created_utc", "source")


@query("label_merge_first_wins", "G2", f"""WITH {POSTS}, {LABELS}, {CONV}
SELECT author, label, 'first' AS source FROM labels_t
UNION ALL SELECT DISTINCT author, 'neither', 'second' FROM conv""")
def q_label_merge(spark, sf):
    posts, conv = v.posts(spark, sf), v.conversation_posts(spark, sf)
    labels = v.labels(spark, sf).select("author", "label")
    other = labels.withColumn("label", F.lit("neither")).unionByName(conv.select("author").distinct().withColumn("label", F.lit("neither")))
    return merge.merge_sources([("first", posts, labels), ("second", conv, other)])[1].select("author", "label", "source")
