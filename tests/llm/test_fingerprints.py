import hashlib
import random

from pyspark.sql import functions as F

from timelens.llm.fingerprints import PLACE, edit_test, fingerprints

from .conftest import prose, row


def test_edited_texts_and_copies(edge, edge_rows):
    got = edit_test(edge.where("doc_id IS NOT NULL AND doc_id <> 8")).collect()
    rows = sorted((r[0], r[1] or "") for r in edge_rows if r[0] not in (None, 8))
    want = {}
    for (d, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        n = len(a)
        want[d] = n, hashlib.sha256((a[:n - n // 2] + b[:n // 2]).encode()).hexdigest()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[4] == prints[5] and prints[1] == prints[2] == ""


def test_all_rows_stay(edge, edge_rows):
    assert edit_test(edge).count() == len(edge_rows)


def winnowed(hashes, w):
    """Places by the definition: the smallest of each window, the rightmost of equal ones."""
    out = set()
    for i in range(max(1, len(hashes) - w + 1)) if hashes else []:
        part = hashes[i:i + w]
        out.add(i + max(j for j, h in enumerate(part) if h == min(part)))
    return out


def test_winnowing_equals_the_definition(ready_spark, edge):
    rng = random.Random(4)
    words = ["red", "blue", "green"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in range(0, 60)]
    df = ready_spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], edge.schema)
    # With windows of one run every run is kept, which gives all hashes.
    every = {r.doc_id: {x.place: x.hash for x in r.kept} for r in fingerprints(df, w=1).collect()}
    for w in (2, 4, 8):
        for r in fingerprints(df, w=w).collect():
            hashes = [every[r.doc_id][i] for i in range(len(every[r.doc_id]))]
            assert {x.place for x in r.kept} == winnowed(hashes, w)
            assert all(x.hash == hashes[x.place] for x in r.kept)


def test_shared_runs_are_found(ready_spark, edge):
    rng = random.Random(6)
    shared = " ".join(prose(rng, 1) + str(i) for i in range(7))
    df = ready_spark.createDataFrame([row(1, f"{prose(rng, 30)} {shared} {prose(rng, 5)}"), row(2, f"{prose(rng, 11)} {shared} {prose(rng, 40)}")], edge.schema)
    a, b = ({x.hash for x in r.kept} for r in fingerprints(df).collect())
    assert a & b


def test_skewed_ids(ready_spark, edge):
    rows = [row(5 if i % 3 else i * 10 ** 12, f"text number {i} with some words in it") for i in range(2000)]
    got = edit_test(ready_spark.createDataFrame(rows, edge.schema).repartition(4))
    assert got.count() == 2000


def test_one_row_and_none(ready_spark, edge, empty):
    got = edit_test(ready_spark.createDataFrame([row(1, "abcd")], edge.schema)).first()
    assert got.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and got.near_next == 1.0
    assert edit_test(empty).count() == 0


def test_every_place_of_the_longest_string_fits():
    """Tokens take two bytes at least: a character and a space, or three bytes of a script without spaces."""
    assert PLACE >= (2 ** 31 - 1) // 2 and PLACE < 2 ** 31


def test_places_of_a_long_text_rise(ready_spark):
    df = ready_spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.hex(i % 997)), " ").alias("text"))
    places = [r.place for r in fingerprints(df).first().kept]
    assert places == sorted(set(places)) and places[-1] > 199_980
