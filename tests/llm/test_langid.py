import zlib

from pyspark.sql import functions as F

from timelens.llm import langid
from timelens.llm.entry import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(ready_spark):
    got = QUERIES["op6_language_profiles"](ready_spark, SF).toPandas()
    docs = ready_spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) == len(both)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_edges(edge, edge_rows):
    protos = langid.learn(edge)
    assert set(protos) == {"en", "de", "fr"}
    got = langid.identify(edge, protos, ["doc_id"]).collect()
    assert len(got) == len(edge_rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3, 18, 20} and all(r.score == 0 for r in got if r.lang_pred == "und")
    same = {(r.lang_pred, r.score) for r in got if r.doc_id == 8}
    assert len(same) == 1


def test_bundle_is_the_sum_of_bound_letters():
    first, second, third = langid.letter_vectors()
    owner, codes = langid.trigrams(["ab", "", "b"])
    got = langid.bundle(owner, codes, 3)
    want = first[0] * second[1] * third[2] + first[1] * second[2] * third[0]
    assert (got[0] == want).all() and not got[1].any() and (got[2] == first[0] * second[2] * third[0]).all()


def test_any_split_learns_the_same(edge):
    a, b = langid.learn(edge.coalesce(1)), langid.learn(edge.repartition(7))
    assert all((a[k] == b[k]).all() for k in a)


def test_nothing_learned(edge, empty, edge_rows):
    assert langid.learn(empty) == {}
    got = langid.identify(edge, {}, ["doc_id"])
    assert got.where("lang_pred <> 'und' OR score <> 0").count() == 0 and got.count() == len(edge_rows)
    assert langid.identify(empty, {}, ["doc_id"]).count() == 0


def test_keeps_all_columns(edge):
    protos = langid.learn(edge)
    kept = langid.keep_identified(edge, protos)
    assert kept.schema == edge.schema
    assert kept.where(F.col("doc_id").isin(1, 2, 3, 18, 20)).count() == 0
