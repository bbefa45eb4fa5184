"""Keyed table: results as by plain Python, which leaves an append touches, races, interruptions and replays."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.sources.keyed import KeyedTable
from timelens.streaming import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("created_utc", T.LongType()), T.StructField("note", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, **kw):
    return KeyedTable(spark, str(path), SCHEMA, "id", **kw)


def put(t, df, batch=None):
    return t.append(df, [F.col("created_utc"), F.col("note")], batch)


def test_first_row_of_a_key_stays_through_splits_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    t, want = table(spark, tmp_path / "t", split_rows=25, compact_at=2), {}
    for k in range(4):
        rows = [(rng.choice([None, *[f"k{i}" for i in range(60 * (k + 1))]]), rng.randrange(50), f"b{k}-{i}") for i in range(80)]
        rows += rows[:5]
        put(t, frame(spark, rows))
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            want.setdefault(r[0], r)
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(want.values(), key=str)
    m = t.manifest()
    assert m["version"] == 4 and sum(leaf["rows"] for leaf in m["leaves"]) == len(want)
    assert sum(2.0 ** -leaf["bits"] for leaf in m["leaves"]) == 1.0  # the leaves are a partition of all digests
    assert all(len(leaf["folders"]) <= 2 for leaf in m["leaves"]) and max(leaf["rows"] for leaf in m["leaves"]) <= 50


def test_an_append_touches_the_leaves_of_its_keys_only(spark, tmp_path):
    t = table(spark, tmp_path / "t", split_rows=20)
    put(t, frame(spark, [(f"k{i}", 0, "old") for i in range(600)]))
    before = {(f["bits"], f["tail"]): f["folders"] for f in t.manifest()["leaves"]}
    assert len(before) >= 32
    put(t, frame(spark, [("new-key", 1, "new"), ("k7", 1, "new")]))
    after = {(f["bits"], f["tail"]): f["folders"] for f in t.manifest()["leaves"]}
    changed = [at for at in before if after.get(at) != before[at]]
    assert len(changed) == 1
    assert t.read().filter("note = 'new'").count() == 1


@pytest.mark.parametrize("history", [200, 1600])
def test_what_a_batch_reads_does_not_grow_with_the_history(spark, tmp_path, history):
    t = table(spark, tmp_path / "t", split_rows=20)
    put(t, frame(spark, [(f"k{i}", 0, "old") for i in range(history)]))
    batch = frame(spark, [(f"x{i}", 1, "new") for i in range(3)])
    hit = {(r["_bits"], r["_tail"]) for r in t._in_leaves(batch, t.manifest()["leaves"]).collect()}
    assert len(hit) <= 3 and sum(f["rows"] for f in t.manifest()["leaves"] if (f["bits"], f["tail"]) in hit) <= 3 * 40


def test_an_interrupted_append_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    put(t, frame(spark, [("a", 0, "old")]))

    def stop(manifest):
        raise RuntimeError("executor and driver lost")

    monkeypatch.setattr(t, "_commit", stop)
    with pytest.raises(RuntimeError):
        put(t, frame(spark, [("b", 0, "new")]))
    again = table(spark, tmp_path / "t")
    assert [r["id"] for r in again.read().collect()] == ["a"]
    put(again, frame(spark, [("b", 0, "new")]))
    assert sorted(r["id"] for r in again.read().collect()) == ["a", "b"]


def test_writers_at_the_same_time_lose_no_rows(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: put(table(spark, tmp_path / "t"), frame(spark, [("shared", k, f"w{k}"), (f"own{k}", 0, "x")])), range(4)))
    rows = table(spark, tmp_path / "t").read().collect()
    assert sorted(r["id"] for r in rows) == ["own0", "own1", "own2", "own3", "shared"]
    assert table(spark, tmp_path / "t").manifest()["version"] == 4


def test_edge_batches(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0 and put(t, frame(spark, []))["version"] == 0
    put(t, spark.createDataFrame([("a", "more", 1)], "id string, extra string, _tail int").withColumn("created_utc", F.lit(3)), 0)
    assert [tuple(r) for r in t.read().collect()] == [("a", 3, None)]
    assert put(t, frame(spark, [("b", 0, "replayed")]), 0)["version"] == 1 and t.read().count() == 1


def test_stream_with_copies_in_later_files(spark, tmp_path):
    src = str(tmp_path / "in")
    for ids in (["a", "b"], ["b", "c", "c"], ["a", "d"]):
        frame(spark, [(i, 1, "n") for i in ids]).coalesce(1).write.mode("append").parquet(src)
    t = table(spark, tmp_path / "t", split_rows=1)
    posts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.collect_keyed(posts, t, str(tmp_path / "chk")).awaitTermination()
    assert sorted(r["id"] for r in t.read().collect()) == ["a", "b", "c", "d"]
