"""Timeline queries: cleaning, labelling, windows and the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LINGUISTIC, PRE_WINDOWS, STYLE, TEMPORAL, WINDOWS
from ..functions import text as tx
from ..functions import timefn as tm
from ..operators import clean, linguistic, style, temporal, turning_point, zscore
from . import views as v
from .registry import query
from .views import AGED, FACTS, LABELS, POSTS, TEXT

DAY = 86_400_000_000


def window_cols(features):
    return [f"{f}_{w}" for w in WINDOWS for f in features]


def delta_cols(features):
    return [f"{f}_delta_{w}" for w in PRE_WINDOWS for f in features]


def deltas_sql(features):
    return ", ".join(f'"{f}_{w}" - "{f}_baseline" AS "{f}_delta_{w}"' for w in PRE_WINDOWS for f in features)


def pivot_sql(features, source):
    """Wide row per labelled author from a long CTE ``source(author, w, <features>)``."""
    items = ", ".join(f'max(CASE WHEN w = \'{w}\' THEN {f} END) AS "{f}_{w}"' for w in WINDOWS for f in features)
    return f"SELECT author, {items} FROM {source} GROUP BY author"


# ------------------------------------------------------------------ flagship
@query("flagship_label_window_means", "B1 B4 H4 D4 D5 B9 D10 D18 D13 D34", f"""
WITH {POSTS}, {LABELS}, {AGED},
agg AS (SELECT author, w, count(*) AS n, min(created_utc) AS lo, max(created_utc) AS hi,
               avg(CASE WHEN hour(created_utc) < 4 THEN 1.0 ELSE 0.0 END) AS late_night_rate
        FROM inwin GROUP BY author, w),
grid AS (SELECT l.author, l.label, win.w, coalesce(a.n, 0) AS n, a.late_night_rate,
                CASE WHEN coalesce(a.n, 0) = 0 THEN 0.0
                     WHEN win.w = 'baseline' THEN a.n / greatest(date_sub('day', a.lo, a.hi)::DOUBLE, 1.0)
                     ELSE a.n / win.hi::DOUBLE END AS post_freq
         FROM labels_t l CROSS JOIN win LEFT JOIN agg a ON a.author = l.author AND a.w = win.w),
full_t AS (SELECT *, post_freq - first_value(post_freq) OVER (PARTITION BY author ORDER BY w) AS post_freq_delta,
                late_night_rate - first_value(late_night_rate) OVER (PARTITION BY author ORDER BY w) AS late_night_delta
         FROM grid)
SELECT label, w AS "window", count(*) AS users, avg(post_freq) AS post_freq, avg(late_night_rate) AS late_night_rate,
       CASE WHEN w <> 'baseline' THEN avg(post_freq_delta) END AS post_freq_delta,
       CASE WHEN w <> 'baseline' THEN avg(late_night_delta) END AS late_night_delta
FROM full_t GROUP BY label, w""", "post_freq late_night_rate post_freq_delta late_night_delta")
def flagship(spark, sf):
    """Posts, cleaned and labelled, to mean posting rate and night share by label and window."""
    posts = clean.clean_posts(v.posts(spark, sf))
    labels = turning_point.label_users(posts, v.RULES)
    aged = turning_point.attach_age(posts.select("author", "id", "created_utc"), labels)
    aggs = []
    for w, inside in tm.window_flags(F.col("age"), v.UNIT).items():
        aggs += [F.count(F.when(inside, 1)).alias(f"n_{w}"),
                 F.min(F.when(inside, F.col("created_utc"))).alias(f"lo_{w}"),
                 F.max(F.when(inside, F.col("created_utc"))).alias(f"hi_{w}"),
                 F.avg(F.when(inside, (F.hour("created_utc") < 4).cast("double"))).alias(f"late_night_rate_{w}")]
    wide = aged.groupBy("author").agg(*aggs)
    wide = wide.select("author", *[c for w in WINDOWS for c in (
        F.col(f"late_night_rate_{w}"),
        linguistic.window_frequency(F.col(f"n_{w}"), F.col(f"lo_{w}"), F.col(f"hi_{w}"), w, v.UNIT).alias(f"post_freq_{w}"))])
    users = labels.select("author", "label").join(wide, "author")
    sides = [f"'{w}', post_freq_{w}, late_night_rate_{w}, "
             f"{f'post_freq_{w} - post_freq_baseline' if w != 'baseline' else 'cast(null as double)'}, "
             f"{f'late_night_rate_{w} - late_night_rate_baseline' if w != 'baseline' else 'cast(null as double)'}"
             for w in WINDOWS]
    long = users.select("label", F.expr(
        f"stack(4, {', '.join(sides)}) as (`window`, post_freq, late_night_rate, post_freq_delta, late_night_delta)"))
    return long.groupBy("label", "window").agg(
        F.count(F.lit(1)).alias("users"), *[F.avg(c).alias(c) for c in
                                            ("post_freq", "late_night_rate", "post_freq_delta", "late_night_delta")])


# ------------------------------------------------------------------ projections and filters
DIRTY = f"""{POSTS},
dirty AS (SELECT CASE WHEN event_id % 19 = 0 THEN '[removed]' ELSE author END AS author, id,
  CASE WHEN event_id % 23 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN '[deleted]' ELSE body END AS body,
  CASE WHEN event_id % 29 <> 0 THEN created_utc END AS created_utc, subreddit, title, score FROM posts)"""


@query("clean_posts", "B1", f"""WITH {DIRTY}
SELECT author, id, created_utc, length(body) AS body_len, title FROM dirty
WHERE author IS NOT NULL AND body IS NOT NULL AND created_utc IS NOT NULL
  AND author NOT IN ('[deleted]', '[removed]') AND length(trim(body)) > 0
  AND trim(body) NOT IN ('[deleted]', '[removed]')""")
def q_clean(spark, sf):
    return clean.clean_posts(v.dirty_posts(spark, sf)).select(
        "author", "id", "created_utc", F.length("body").cast("long").alias("body_len"), "title")


@query("lenient_timestamp", "B2", """
SELECT event_id, try_cast(CASE WHEN event_id % 13 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS created_utc
FROM events""")
def q_lenient(spark, sf):
    raw = F.when(F.col("event_id") % 13 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.table(spark, sf, "events").select("event_id", clean.parse_time(raw).alias("created_utc"))


@query("text_composition", "B3", f"""WITH {POSTS},
t AS (SELECT id, regexp_replace(coalesce(title,'') || ' ' || coalesce(body,''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS trimmed,
        coalesce(body,'') || ' ' || coalesce(title,'') AS feat, coalesce(title,'') || ' ' || coalesce(body,'') AS lab FROM posts)
SELECT id, md5(feat) AS feature_text, md5(lab) AS label_text, md5(trimmed) AS trimmed_text,
       CASE WHEN length(trimmed) > 10 THEN md5(trimmed) END AS usable_text FROM t""")
def q_text(spark, sf):
    trimmed = tx.compose("title", "body", trim=True)
    return v.posts(spark, sf).select(
        "id", F.md5(tx.compose("body", "title")).alias("feature_text"), F.md5(tx.compose("title", "body")).alias("label_text"),
        F.md5(trimmed).alias("trimmed_text"), F.when(F.length(trimmed) > 10, F.md5(trimmed)).alias("usable_text"))


@query("active_posts", "B4 C9", f"""WITH {POSTS}
SELECT author, id, created_utc FROM posts WHERE author IN (SELECT author FROM posts GROUP BY author HAVING count(*) > 60)""")
def q_active(spark, sf):
    return clean.active_posts(v.posts(spark, sf), 60).select("author", "id", "created_utc")


@query("labelled_posts", "B5 C9", f"""WITH {POSTS}, {LABELS}
SELECT author, id, created_utc FROM posts WHERE author IN (SELECT author FROM labels_t WHERE label IN ('crisis', 'recovery'))""")
def q_labelled(spark, sf):
    return clean.labelled_posts(v.posts(spark, sf).select("author", "id", "created_utc"), v.labels(spark, sf))


@query("high_confidence_users", "B6", f"""WITH {POSTS}, {LABELS}
SELECT author, label, low_confidence FROM labels_t WHERE NOT (label = 'recovery' AND low_confidence)""")
def q_high(spark, sf):
    return clean.high_confidence(v.labels(spark, sf)).select("author", "label", "low_confidence")


@query("usable_posts_capped", "B7 E8", f"""WITH {POSTS},
u AS (SELECT author, id, created_utc FROM posts
      WHERE length(regexp_replace(coalesce(title,'') || ' ' || coalesce(body,''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) > 10)
SELECT author, id, created_utc FROM u
QUALIFY count(*) OVER (PARTITION BY author) >= 5 AND row_number() OVER (PARTITION BY author ORDER BY created_utc, id) <= 20""")
def q_usable(spark, sf):
    return clean.usable_posts(v.posts(spark, sf), 5, 20).select("author", "id", "created_utc")


@query("cap_per_kind", "B8 E8", """
SELECT author, id, created_utc, subreddit FROM (
  SELECT concat('c', conv_id) AS author, concat_ws('_', conv_id, turn) AS id, role AS subreddit,
         TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INTEGER)) AS created_utc FROM conversations)
QUALIFY row_number() OVER (PARTITION BY author, subreddit ORDER BY created_utc, id) <= 2""")
def q_cap(spark, sf):
    return clean.cap_per_kind(v.conversation_posts(spark, sf), "subreddit", 2).select("author", "id", "created_utc", "subreddit")


@query("window_membership", "B9 B10 C1 C3 H13", f"""WITH {POSTS}, {LABELS}, {AGED}
SELECT author, id, age, age > 4*{DAY} AS baseline, age > 0 AND age <= 4*{DAY} AS pre_4w,
       age > 0 AND age <= 2*{DAY} AS pre_2w, age > 0 AND age <= {DAY} AS pre_1w FROM aged""")
def q_windows(spark, sf):
    posts = v.posts(spark, sf)
    aged = turning_point.attach_age(posts.select("author", "id", "created_utc"), v.labels(spark, sf))
    return aged.select("author", "id", "age", *[c.alias(w) for w, c in tm.window_flags(F.col("age"), v.UNIT).items()])


@query("pseudo_turning_point", "B10 E9", f"""WITH {POSTS}, {LABELS}
SELECT author, coalesce(tp_date, (SELECT max(created_utc) FROM posts p WHERE p.author = labels_t.author)) AS anchor FROM labels_t""")
def q_pseudo(spark, sf):
    labels = v.labels(spark, sf).select("author", "tp_date")
    return turning_point.pseudo_anchor(v.posts(spark, sf), labels).select("author", "anchor")


@query("last_post_anchor", "E9", f"""WITH {POSTS}
SELECT author, id, max(created_utc) OVER (PARTITION BY author) AS last_ts FROM posts""")
def q_last(spark, sf):
    return turning_point.last_post_time(v.posts(spark, sf).select("author", "id", "created_utc")).select("author", "id", "last_ts")


@query("days_to_turning_point", "B11", f"""WITH {POSTS}, {LABELS}
SELECT p.author, p.id, date_diff('microsecond', l.tp_date, p.created_utc) / 86400000000.0 AS days_to_tp
FROM posts p JOIN labels_t l USING (author)""", "days_to_tp")
def q_days(spark, sf):
    posts = v.posts(spark, sf).select("author", "id", "created_utc")
    return turning_point.days_to_turning_point(posts, v.labels(spark, sf)).select("author", "id", "days_to_tp")


@query("low_confidence_flag", "B12", f"""WITH {POSTS}, {LABELS}
SELECT author, tp_matched_phrase, low_confidence FROM labels_t""")
def q_low(spark, sf):
    return v.label_table(spark, sf).select("author", "tp_matched_phrase", "low_confidence")


# ------------------------------------------------------------------ labelling
@query("phrase_matches", "H4 H5", f"""WITH {POSTS}, {LABELS}
SELECT id, lab AS label, regexp_extract(coalesce(title,'') || ' ' || coalesce(body,''),
  CASE WHEN lab = 'crisis' THEN '(?i)(error severe|error extreme)' ELSE '(?i)(purchase severe|purchase extreme)' END, 1) AS phrase
FROM m WHERE lab IS NOT NULL""")
def q_matches(spark, sf):
    return turning_point.matches(v.posts(spark, sf), v.RULES).select("id", "label", "phrase")


@query("first_matching_post", "D4 E1 F1", f"""WITH {POSTS}, {LABELS}
SELECT author, lab AS label, tp_ts AS tp_date, tp_id AS tp_post_id, tp_sub AS tp_subreddit, phrase AS tp_matched_phrase FROM tp""")
def q_first(spark, sf):
    return turning_point.first_match(v.posts(spark, sf), v.RULES)


@query("user_labels", "D4 D5 D6 B4", f"""WITH {POSTS}, {LABELS}
SELECT author, label, n_posts, tp_post_id, tp_date, tp_subreddit, tp_matched_phrase, low_confidence FROM labels_t""")
def q_labels(spark, sf):
    return v.label_table(spark, sf).drop("first_ts", "last_ts", "anchor")


# ------------------------------------------------------------------ linguistic family
@query("post_facts", "H1 H3 H7 H10 H11 D9", f"""WITH {POSTS}, {FACTS}
SELECT author, id, created_utc, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_first AS BIGINT) AS n_first,
       CAST(n_negative AS BIGINT) AS n_negative, sent_len, sentiment FROM scored""", "sent_len sentiment")
def q_facts(spark, sf):
    return linguistic.post_facts(v.posts(spark, sf), v.lexicon(spark, sf), v.FIRST, v.NEGATIVE)


LONG = f"""{POSTS}, {LABELS}, {AGED}, {FACTS},
lw AS (SELECT i.w, s.* FROM inwin i JOIN scored s USING (id)),
kinds AS (SELECT author, w, count(DISTINCT token) AS kinds FROM (SELECT author, w, unnest(list_distinct(tokens)) AS token FROM lw) GROUP BY author, w),
sums AS (SELECT author, w, count(*) AS n, min(created_utc) AS lo, max(created_utc) AS hi, avg(sentiment) AS sentiment_mean,
                avg(sent_len) AS avg_sent_len, sum(n_tokens)::DOUBLE AS tok, sum(n_first)::DOUBLE AS fp, sum(n_negative)::DOUBLE AS neg
         FROM lw GROUP BY author, w),
lng AS (SELECT l.author, win.w, sentiment_mean, CASE WHEN tok >= 2 THEN kinds / tok END AS ttr, avg_sent_len,
               CASE WHEN coalesce(n, 0) = 0 THEN 0.0
                    WHEN win.w = 'baseline' THEN n / greatest(date_sub('day', s.lo, s.hi)::DOUBLE, 1.0)
                    ELSE n / win.hi::DOUBLE END AS post_freq,
               CASE WHEN tok > 0 THEN fp / tok END AS fp_pronoun_rate, CASE WHEN tok > 0 THEN neg / tok END AS neg_affect_rate,
               tok / n AS avg_post_len
        FROM labels_t l CROSS JOIN win LEFT JOIN sums s ON s.author = l.author AND s.w = win.w
        LEFT JOIN kinds k ON k.author = l.author AND k.w = win.w),
wide AS ({pivot_sql(LINGUISTIC, 'lng')})"""


@query("linguistic_windows", "D7 D8 D9 D10 D11 D12", f"WITH {LONG} SELECT * FROM wide", window_cols(LINGUISTIC))
def q_linguistic(spark, sf):
    return linguistic.linguistic_windows(v.posts(spark, sf), v.labels(spark, sf), v.lexicon(spark, sf), v.UNIT, **v.LISTS)


@query("raw_features", "D13", f"WITH {LONG} SELECT *, {deltas_sql(LINGUISTIC)} FROM wide",
       window_cols(LINGUISTIC) + delta_cols(LINGUISTIC))
def q_raw(spark, sf):
    return linguistic.raw_features(v.posts(spark, sf), v.labels(spark, sf), v.lexicon(spark, sf), v.UNIT, **v.LISTS)


# ------------------------------------------------------------------ z-scores
BUCKETS = f"""{LONG},
bk AS (SELECT a.author, s.*  EXCLUDE (author), (a.age - 4*{DAY} - 1) // {DAY} AS bucket FROM aged a JOIN scored s USING (id) WHERE a.age > 4*{DAY}),
bkinds AS (SELECT author, bucket, count(DISTINCT token) AS kinds FROM (SELECT author, bucket, unnest(list_distinct(tokens)) AS token FROM bk) GROUP BY 1, 2),
bsums AS (SELECT author, bucket, count(*)::DOUBLE AS post_freq, avg(sentiment) AS sentiment_mean, avg(sent_len) AS avg_sent_len,
                 sum(n_tokens)::DOUBLE AS tok, sum(n_first)::DOUBLE AS fp, sum(n_negative)::DOUBLE AS neg FROM bk GROUP BY 1, 2),
bf AS (SELECT author, bucket, sentiment_mean, CASE WHEN tok >= 2 THEN kinds / tok END AS ttr, avg_sent_len, post_freq,
              CASE WHEN tok > 0 THEN fp / tok END AS fp_pronoun_rate, CASE WHEN tok > 0 THEN neg / tok END AS neg_affect_rate,
              tok / post_freq AS avg_post_len
       FROM bsums LEFT JOIN bkinds USING (author, bucket))"""

STATS = f"""{BUCKETS},
st AS (SELECT author, {', '.join(f'avg({f}) AS {f}_mean, stddev_samp({f}) AS {f}_std, count({f}) AS {f}_n' for f in LINGUISTIC)}
       FROM bf GROUP BY author)"""
Z_COLS = [f"{f}_znorm_{w}" for w in PRE_WINDOWS for f in LINGUISTIC]
ZSQL = f"""{STATS},
z AS (SELECT author, coalesce(greatest({', '.join(f'{f}_n' for f in LINGUISTIC)}), 0) AS n_baseline_buckets,
  {', '.join(f'CASE WHEN {f}_std > 0 THEN ("{f}_{w}" - {f}_mean) / {f}_std END AS "{f}_znorm_{w}"' for w in PRE_WINDOWS for f in LINGUISTIC)},
  {', '.join(f'CASE WHEN "post_freq_{w}" > 0 THEN 1.0 ELSE 0.0 END AS "has_posts_{w}"' for w in PRE_WINDOWS)}
  FROM wide LEFT JOIN st USING (author))"""


@query("baseline_buckets", "D14", f"WITH {BUCKETS} SELECT * FROM bf", LINGUISTIC)
def q_buckets(spark, sf):
    return zscore.bucket_features(v.posts(spark, sf), v.labels(spark, sf), v.lexicon(spark, sf), v.UNIT, v.FIRST, v.NEGATIVE)


@query("baseline_bucket_stats", "D15", f"WITH {STATS} SELECT *, greatest({', '.join(f'{f}_n' for f in LINGUISTIC)}) AS n_baseline_buckets FROM st",
       [f"{f}_{s}" for f in LINGUISTIC for s in ("mean", "std")])
def q_bucket_stats(spark, sf):
    return zscore.bucket_stats(q_buckets(spark, sf))


def z_features(spark, sf):
    return zscore.zscore_features(v.posts(spark, sf), v.labels(spark, sf), v.lexicon(spark, sf), v.UNIT, **v.LISTS)


@query("zscore_features", "D16 B13", f"WITH {ZSQL} SELECT * FROM z", Z_COLS + [f"has_posts_{w}" for w in PRE_WINDOWS])
def q_z(spark, sf):
    return z_features(spark, sf)


@query("zscore_coverage", "D35", f"""WITH {ZSQL}
SELECT count(*) AS users, count(*) FILTER (n_baseline_buckets >= 2) AS users_with_z, median(n_baseline_buckets) AS median_buckets FROM z""",
       "median_buckets")
def q_cover(spark, sf):
    return zscore.coverage(z_features(spark, sf))


# ------------------------------------------------------------------ temporal family
TEMP = f"""{POSTS}, {LABELS}, {AGED},
hc AS (SELECT author, w, hour(created_utc) AS h, count(*)::DOUBLE AS c FROM inwin GROUP BY 1, 2, 3),
ent AS (SELECT author, w, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(24.0) AS hour_entropy FROM hc GROUP BY 1, 2),
shares AS (SELECT author, w, avg(CASE WHEN hour(created_utc) < 4 THEN 1.0 ELSE 0.0 END) AS late_night_rate,
                  avg(CASE WHEN isodow(created_utc) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_rate FROM inwin GROUP BY 1, 2),
gp AS (SELECT author, w, (date_diff('microsecond', lag(created_utc) OVER (PARTITION BY author, w ORDER BY created_utc, id), created_utc)
               // 1000000) / 3600.0 AS hrs FROM inwin),
gs AS (SELECT author, w, avg(hrs) AS interval_mean_hr, stddev_samp(hrs) AS interval_std_hr, max(hrs) AS max_gap_hr FROM gp GROUP BY 1, 2),
tmp AS (SELECT l.author, win.w, hour_entropy, late_night_rate, interval_mean_hr, interval_std_hr, max_gap_hr, weekend_rate
        FROM labels_t l CROSS JOIN win LEFT JOIN ent USING (author, w) LEFT JOIN shares USING (author, w) LEFT JOIN gs USING (author, w)),
wide AS ({pivot_sql(TEMPORAL, 'tmp')})"""


@query("temporal_features", "D17 D18 D19 D20 E2", f"WITH {TEMP} SELECT *, {deltas_sql(TEMPORAL)} FROM wide",
       window_cols(TEMPORAL) + delta_cols(TEMPORAL))
def q_temporal(spark, sf):
    return temporal.temporal_features(v.posts(spark, sf), v.labels(spark, sf), v.UNIT)


@query("order_gaps", "D19 E2", """
WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS author,
  date_diff('second', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)), o_orderdate) / 3600.0 AS hours
  FROM orders)
SELECT author, count(hours) AS gaps, avg(hours) AS mean_hours, stddev_samp(hours) AS std_hours, max(hours) AS max_hours
FROM g WHERE hours IS NOT NULL GROUP BY author""", "mean_hours std_hours max_hours")
def q_order_gaps(spark, sf):
    """Real weeks: gaps between a customer's orders, cut into seven-day chunks."""
    end = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    aged = v.orders_timeline(spark, sf).withColumn("age", tm.micros_between(F.col("created_utc"), end))
    pairs = temporal.gaps(aged, tm.unit_micros(7))
    hours = F.call_function("div", F.col("prev_age") - F.col("age"), F.lit(1_000_000)) / F.lit(3600.0)
    return (pairs.withColumn("hours", hours).groupBy("author")
            .agg(F.count("hours").alias("gaps"), F.avg("hours").alias("mean_hours"),
                 F.stddev_samp("hours").alias("std_hours"), F.max("hours").alias("max_hours")))


# ------------------------------------------------------------------ style family
STY = f"""{POSTS}, {LABELS}, {AGED},
sf0 AS (SELECT *, {TEXT} AS text FROM inwin),
sf1 AS (SELECT author, w, {v.tokens_sql('text')} AS tk, {v.words_sql('text')} AS wd, text FROM sf0),
sf2 AS (SELECT author, w, sum(len(tk))::DOUBLE AS tok, sum(length(text) - length(replace(text, '!', '')))::DOUBLE AS ex,
   sum(length(text) - length(replace(text, '?', '')))::DOUBLE AS qu, sum(len(regexp_extract_all(text, '\\.{{3,}}')))::DOUBLE AS el,
   sum(len(wd))::DOUBLE AS nw, sum(len(list_filter(wd, lambda x: length(x) >= 2 AND upper(x) = x AND lower(x) <> x)))::DOUBLE AS caps,
   sum(len(list_filter(tk, lambda x: x IN {v.in_list(v.FIRST)})))::DOUBLE AS ni, sum(len(list_filter(tk, lambda x: x IN {v.in_list(v.WE)})))::DOUBLE AS nwe,
   sum(len(list_filter(tk, lambda x: x IN {v.in_list(v.YOU)})))::DOUBLE AS nyou,
   sum(len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}]+')))::DOUBLE AS bl,
   sum(len({v.sentences_sql('text')}))::DOUBLE AS se, sum(len(regexp_extract_all(lower(text), '[aeiouy]+')))::DOUBLE AS sy
   FROM sf1 GROUP BY author, w),
sty AS (SELECT l.author, win.w,
   CASE WHEN bl >= 3 THEN 206.835 - 1.015 * (bl / greatest(se, 1)) - 84.6 * (sy / bl) END AS flesch_reading_ease,
   CASE WHEN bl >= 3 THEN 0.39 * (bl / greatest(se, 1)) + 11.8 * (sy / bl) - 15.59 END AS flesch_kincaid_grade,
   CASE WHEN tok > 0 THEN ex / tok END AS exclaim_rate, CASE WHEN tok > 0 THEN qu / tok END AS question_rate,
   CASE WHEN tok > 0 THEN el / tok END AS ellipsis_rate, CASE WHEN nw > 0 THEN caps / nw END AS caps_word_rate,
   CASE WHEN tok > 0 THEN ln((ni + 1) / (nwe + 1)) END AS i_vs_we_ratio, CASE WHEN tok > 0 THEN ln((ni + 1) / (nyou + 1)) END AS i_vs_you_ratio
   FROM labels_t l CROSS JOIN win LEFT JOIN sf2 USING (author, w)),
wide AS ({pivot_sql(STYLE, 'sty')})"""


@query("style_features", "D21 D22 D23 D24 D25 H2 H8 H9", f"WITH {STY} SELECT *, {deltas_sql(STYLE)} FROM wide",
       window_cols(STYLE) + delta_cols(STYLE))
def q_style(spark, sf):
    return style.style_features(v.posts(spark, sf), v.labels(spark, sf), v.UNIT, i_words=v.FIRST, we_words=v.WE, you_words=v.YOU)
