import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tok
import pytest
import sentencepiece
from tokenizers import Tokenizer

from timelens.llm import alignment

from .conftest import SCHEMA, row

A, B = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def expected(docs):
    """Plain Python: every pair of tokens compared inside its group."""
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def spans(raw):
        out, at = [], 0
        for i, b in raw:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out

    aligned = []
    for doc, text in docs:
        if not text:
            aligned.append((doc, [], []))
            continue
        a = [(i, bytes(chars[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
             for i, p in ((i, piece.id_to_piece(i)) for i in piece.encode(text))]
        whole = (" " + text).encode()
        ok = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        aligned.append((doc, spans(a), spans(b)) if ok else (doc, [], []))
    held, per_doc = Counter(), []
    for doc, a, b in aligned:
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        links, groups, start = [], [], 0
        for stop in common:
            ga, gb = ([t for t in x if start <= t[1] and t[2] <= stop] for x in (a, b))
            groups.append(",".join(str(t[0]) for t in ga) + "|" + ",".join(str(t[0]) for t in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            start = stop
        held.update(set(links))
        per_doc.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    best: dict = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted([(doc, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), g) for doc, na, nb, ng, links, g in per_doc], key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "Hello world", " lead", "two  spaces\n\tand <|endoftext|> </s> <unk> <0x41>", "▁ piece", "ﬁ ligature", "Größe über alles", "日本語のテキスト", "🙂👍🏽 emoji é",
             "a" * 300, "Hello world", "\x00\x01", "x = y+1; // code", "１２３ wide", "tail ", "a b", "é"]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(None, "no id, Hello world"), row(3, "Hello"), row(3, "Hello")]
    return rows + [row(100 + i, "the same Hello world again") for i in range(30)]


@pytest.mark.parametrize("settings", [{}, {"held_pairs": 10, "shard_pairs": 8, "vector_rows": 4, "task_pairs": 20}, {"held_pairs": 0}])
def test_against_every_pair(ready_spark, rows, settings):
    docs = ready_spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(alignment.align(docs, A, B, **settings)) == expected([r[:2] for r in rows])


def test_query_against_brute_force(ready_spark):
    docs = ready_spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    want = expected(rows)
    made = got(alignment.align(ready_spark.createDataFrame(rows, "doc_id long, text string"), A, B, whole=False))
    assert made == sorted([(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want], key=repr)


def test_empty(empty):
    assert alignment.align(empty, A, B).count() == 0


def test_pair_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        mph = alignment.PairHash(keys)
        assert sorted(mph.numbers(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(rng.integers(-1 << 62, 1 << 62, 1000), keys)
        assert (mph.numbers(other) == -1).all()


def test_texts_are_encoded_once(ready_spark, rows):
    """The first pass writes each document's linked pairs; the second one reads those and no text."""
    docs = ready_spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(2)
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        shared = ready_spark.sparkContext.broadcast((f.read(), g.read()))
    encoded = alignment.materialize(alignment._encoded(docs, shared, 1 << 20, True), "test_encoded")
    assert "text" not in encoded.columns
    want = expected([r[:2] for r in rows])
    single = sorted((r.n_a, r.n_b, r.n_groups, int(alignment._unpacked(alignment.pa.array([r.times]), alignment.TIMES)[0].sum()), r.groups)
                    for r in encoded.where("kind = 0").collect())
    assert single == sorted((na, nb, ng, links, g) for _, na, nb, ng, links, _, _, g in want)
    held = ready_spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(60_000, np.int64)))
    rare = alignment._looked_up(encoded, held, "groups").where("kind = 1").agg({"n_links": "sum"}).first()[0]
    assert rare == sum(links for *_, links, _, _, _ in want)
