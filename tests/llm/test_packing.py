import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from tokenizers import Tokenizer as Library

from timelens.llm.packing import Packer, Tokenizer, pack

FILE = tok.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(FILE)


def check(rows, texts, library, size):
    """Pieces tile their documents and sequences; ids and digests are right. Returns tokens, sequences."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    assert sorted(k for k, v in docs.items() for r in v if r.start == 0) == want
    for (doc, total), pieces in docs.items():
        assert sum(r.length for r in pieces) == total * sum(r.start == 0 for r in pieces)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows), len(seqs)


@pytest.mark.parametrize("size,n_open", [(2048, 32), (64, 4), (8, 1)])
def test_pieces(edge, edge_rows, library, size, n_open):
    rows = pack(edge, FILE, size=size, n_open=n_open, max_pad=size // 128).collect()
    tokens, seqs = check(rows, [r[:2] for r in edge_rows], library, size)
    assert seqs * size - tokens < size + size // 128 * seqs + 1
    coded = {r[0]: np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in edge_rows}
    for r in rows:
        if r.doc_id is not None:
            ids = coded[r.doc_id][r.start:r.start + r.length]
            assert bytes(r.ids) == ids.tobytes() and r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_same_ids_as_the_library(library):
    with open(FILE, encoding="utf-8") as f:
        tok_ = Tokenizer(f.read())
    assert tok_.fast
    for text in ["", "a b", "Ünïcode — ok’s", "<|endoftext|> x", "a<|endoftext|>", "中文 🙂", "\x1c\x85  x", "it's we'll I'd", "  two  spaces \n\n x", "１２ ½ ²"]:
        assert tok_.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_best_fit_and_fullest_leaves():
    p = Packer(10, 2, 0, 0)
    add = lambda d, n: p.add(d, 0, np.arange(n), n)
    add(1, 6), add(2, 7)
    add(3, 3)  # best fit: fills the window of 7
    assert [x[0] for x in p.done] == [2, 3]
    add(4, 5)  # a new window
    add(5, 6)  # fits none: the fullest (6) is filled with its head and leaves
    assert [(x[0], len(x[2])) for x in p.done[2:4]] == [(1, 6), (5, 4)]
    p.close()
    assert sum(len(x[2]) for x in p.done) == 6 + 7 + 3 + 5 + 6 and not p.open


def test_empty(empty):
    assert pack(empty, FILE).count() == 0
