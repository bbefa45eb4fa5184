"""Explicit schemas. Missing numbers are SQL NULL everywhere; NaN appears only inside ML vectors."""

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_utc", T.TimestampNTZType()),
    T.StructField("id", T.StringType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("url", T.StringType()),
    T.StructField("days_to_tp", T.DoubleType()),
])

LANDED_POST = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_utc", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("num_comments", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("upvote_ratio", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("permalink", T.StringType()),
])

LANDED_BLOG_POST = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("dialogue", T.ArrayType(T.StructType([T.StructField("phrase", T.StringType())]))),
    T.StructField("timestamp", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("reply_count", T.StringType()),
    T.StructField("note_count", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("post_url", T.StringType()),
])

# Numbers, flags and lists of landed payloads are read as their source text, so that no spelling of them is lost at the scan;
# the normalisers turn them into values.
FILTERS = T.StructType([
    T.StructField("zip", T.StringType()),
    T.StructField("insurance", T.StringType()),
    T.StructField("ageGroup", T.StringType()),
    T.StructField("telehealth", T.StringType()),
    T.StructField("urgency", T.StringType()),
    T.StructField("sessionFormat", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("providerGender", T.StringType()),
    T.StructField("concerns", T.StringType()),
    T.StructField("modalities", T.StringType()),
    T.StructField("cultural", T.StringType()),
    T.StructField("accessibility", T.StringType()),
])

INTERACTION = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("providerId", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("insuranceMatch", T.StringType()),
    T.StructField("insurancePartial", T.StringType()),
    T.StructField("ageMatch", T.StringType()),
    T.StructField("concernsOverlap", T.StringType()),
    T.StructField("telehealthMatch", T.StringType()),
    T.StructField("languageMatch", T.StringType()),
    T.StructField("genderMatch", T.StringType()),
    T.StructField("modalityOverlap", T.StringType()),
    T.StructField("culturalOverlap", T.StringType()),
    T.StructField("filters", FILTERS),
])

METRICS = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
