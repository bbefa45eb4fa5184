"""Landed JSON in every spelling, late posts, and provider blocks with the default patterns."""

import datetime as dt
import json

from pyspark.sql import functions as F

from timelens.sources import landed
from timelens.streaming import ingest


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "value string")


def test_numbers_in_any_spelling(spark):
    rows = [{"id": "a", "created_utc": 1700000000, "score": 3, "num_comments": None}, {"id": "b", "created_utc": 1700000000.0, "score": 3.0, "num_comments": "7"},
            {"id": "c", "created_utc": "1700000000", "score": "3"}, {"id": "d", "created_utc": "1700000000.25", "score": "x"}, {"id": "e", "created_utc": "soon"},
            {"id": "f"}, {"id": "g", "created_utc": 1e300}, {"id": "h", "created_utc": "", "score": "", "upvote_ratio": "0.5"}, {"id": "i", "created_utc": -1.5, "upvote_ratio": 0}]
    got = {r.id: r for r in landed.landed_posts(lines(spark, rows)).collect()}
    t = dt.datetime(2023, 11, 14, 22, 13, 20)
    assert [got[k].created_utc for k in "abc"] == [t] * 3
    assert got["d"].created_utc == t + dt.timedelta(milliseconds=250)
    assert got["e"].created_utc is None and got["g"].created_utc is None
    assert got["f"].created_utc == got["h"].created_utc == dt.datetime(1970, 1, 1)
    assert got["i"].created_utc == dt.datetime(1969, 12, 31, 23, 59, 58, 500000)
    assert [got[k].score for k in "abcdfh"] == [3, 3, 3, None, 0, 0]
    assert got["a"].num_comments == 0 and got["b"].num_comments == 7
    assert got["h"].upvote_ratio == 0.5 and got["i"].upvote_ratio is None
    blog = landed.landed_blog_posts(lines(spark, [{"type": "text", "body": "x", "id": "a", "timestamp": 1700000000.0, "note_count": "2.0", "author": "z"}])).first()
    assert (blog.created_utc, blog.score) == (t, 2)


def test_rejects_are_counted(spark):
    got = landed.landed_rejects(lines(spark, [{"created_utc": 1}, {"created_utc": "x"}, {}, "{broken", "[1]", '"text"', "null"])).first()
    assert tuple(got) == (7, 4, 1)


def test_interactions_keep_fractions_and_plain_lists(spark, tmp_path):
    rows = [{"type": "rate", "rating": 4.5, "score": 87.5, "filters": {"concerns": "grief", "modalities": ["cbt", "emdr"]}, "insuranceMatch": True, "concernsOverlap": "0.25"},
            {"type": "view", "score": "12", "filters": {"concerns": [], "zip": "02139"}, "ageMatch": "yes", "languageMatch": 0}, {}]
    df = lines(spark, rows)
    flat = landed.flatten_interactions(df).collect()
    assert [(r.rating, r.score, r.concerns, r.modalities, r.zip) for r in flat] == [("4.5", "87.5", "grief", "cbt, emdr", ""), ("", "12", "", "", "02139"), ("", "", "", "", "")]
    df.write.text(str(tmp_path / "in"))
    got = {r.type + str(r.score): r for r in landed.read_interactions(spark, str(tmp_path / "in")).collect()}
    assert got["rate87.5"].rating == 4.5 and got["rate87.5"].insuranceMatch and got["rate87.5"].concernsOverlap == 0.25
    assert got["view12.0"].ageMatch and not got["view12.0"].languageMatch and got["view12.0"].concernsOverlap == 0.5


def test_late_posts_reach_the_sink(spark, tmp_path):
    for form in ("watermark", "exact"):
        src, out, chk = (str(tmp_path / form / x) for x in ("in", "out", "chk"))
        schema = "author string, id string, created_utc timestamp_ntz"
        for day, who in ((20, "a"), (2, "b"), (25, "c"), (3, "d"), (2, "b")):
            one = spark.createDataFrame([("x", who, dt.datetime(2024, 1, day))], schema)
            one.coalesce(1).write.mode("append").parquet(src)
        posts = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ingest.collect_stream(posts, out, chk) if form == "watermark" else ingest.collect_exact(spark, posts, out, chk)
        q.awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_provider_blocks(spark):
    page = ("const P = [ { id: 'one', name: 'A', mark: 'x' }, { id: 'two', mark: 'y', mark: 'z' }, { id: 'one', mark: 'y' } ]; { id: 'open', mark: 'x'")
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page int, html string")
    got = landed.entity_flags(df, "html", r"id: '(\w+)'", ("{ id: '", "'"), "}", {"x": "mark: 'x'", "z": "mark: 'z'"})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "one", True, False), (1, "open", False, False), (1, "two", False, True)]


def test_default_patterns_in_blocks_that_end_on_a_line(spark):
    from timelens.constants import PROVIDER_PATTERNS
    page = ("const PROVIDERS = [\n  {\n    id: 'a', kind: 'Community Mental Health', pay: ['medicaid', 'uninsured'], telehealth: true,\n    hours: ['evening'], x: {},\n  },\n"
            "  {\n    id: 'b', kind: 'Federally Qualified', crisisServices:  true, tags: ['walk_in'], note: 'Crisis Center', telehealth: false\n  },\n];")
    got = landed.entity_flags(spark.createDataFrame([(1, page)], "page int, html string"), "html", r"id:\s*'([^']+)'", ("id: '", "'"), "\n  },\n")
    on = {r.entity: {k for k in PROVIDER_PATTERNS if r[k]} for r in got.collect()}
    assert on == {"a": {"is_cmhc", "accepts_medicaid", "accepts_uninsured", "has_telehealth", "evening_hours"},
                  "b": {"is_fqhc", "is_crisis_center", "has_crisis", "walk_in"}}
