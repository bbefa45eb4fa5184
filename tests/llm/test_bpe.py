import base64
import random

import public_tokenizers as tok
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from timelens.llm.bpe import Bpe, PerfectHash, decode, encode, read_ranks

FILE = tok.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return Bpe(read_ranks(FILE), tok.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Co", "Cs"])))
def test_round_trip(bpe, text):
    raw = bpe.encode([text])[0]
    assert bpe.decode(raw) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeéü 'stlmre\n\t.,!12ßñ中文🙂", max_size=200))
def test_same_ids_as_the_library(bpe, reference, text):
    assert ids(bpe.encode([text])[0]) == reference.encode_ordinary(text)


def test_long_pre_tokens(bpe, reference):
    rng = random.Random(2)
    for text in ["a" * 3000, "".join(rng.choice("abcde") for _ in range(4000)), " " * 500, "\x1c\x1d a\x85b c", "1" * 700]:
        assert ids(bpe.encode([text])[0]) == reference.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(5000)) and sorted(h.number) == list(range(5000))
    assert h.get(b"x") is None and h.get(b"") is None
    assert PerfectHash([b"one"]).get(b"one") == 0


def test_edges(edge, edge_rows, empty, reference):
    got = encode(edge, FILE, tok.PATTERN)
    want = sorted((str(r[0]), r[1] or "") for r in edge_rows)
    rows = got.collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in rows) == want
    assert all(ids(r.ids) == reference.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens * 4 == len(r.ids) for r in rows)
    back = decode(got, FILE, tok.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == want
    assert encode(empty, FILE, tok.PATTERN).count() == 0


def test_other_patterns(ready_spark):
    """Texts of plain characters follow the pattern they are given."""
    path = tok.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = ["Hello world, it's 12345 o'clock", "a  b\n c1d22", "x=y+1;"]
    docs = ready_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (r"\S+|\s+", r"\d{1,3}|\D+", tok.PATTERN):
        lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for r in encode(docs, path, pattern).collect():
            assert [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)] == lib.encode_ordinary(texts[r.doc_id])
