import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from timelens.llm.suffixes import find, remove, repeated, suffix_order

from .conftest import prose, row


def brute(texts, length):
    """For each text: (bytes, removed, spans, digest of the rest, rest)."""
    count = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("hot_rows", [4096, 1])
def test_equals_brute_force(ready_spark, edge, edge_rows, hot_rows):
    rng = random.Random(7)
    line = prose(rng, 45)[:150]
    passage = prose(rng, 200)
    more = [row(3000 + i, prose(rng, rng.randint(5, 60)) + line + prose(rng, rng.randint(5, 60)) + (passage[i:i + 230] if i % 3 else "")) for i in range(40)]
    more += [row(3100, "abc" * 300), row(3101, "x" * 2500), row(3102, "x" * 199), row(3103, "x" * 200)]
    rows = edge_rows + more
    got = find(ready_spark.createDataFrame(rows, edge.schema).repartition(5), hot_rows=hot_rows).collect()
    want = brute([(r[1] or "").encode() for r in rows], 200)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(r[0]), *w[:4]) for r, w in zip(rows, want))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got)
    cut = remove(ready_spark.createDataFrame(rows, edge.schema), hot_rows=hot_rows)
    assert cut.schema == edge.schema and cut.count() == len(rows)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[1] is None and all(text[r[0]] == w[4].decode() for r, w in zip(rows, want) if r[0] not in (None, 1, 8) and (r[1] or "").isascii())


@pytest.mark.parametrize("hot_rows", [4096, 1])
def test_texts_without_id_and_equal_32_bit_hash(ready_spark, edge, hot_rows):
    tail = prose(random.Random(9), 200)[:260]
    one, two = "000000239986" + tail, "000000311700" + tail
    rows = [row(None, one), row(None, two), row(7, one[:230])]
    docs = ready_spark.createDataFrame(rows, edge.schema)
    assert docs.where("doc_id IS NULL").select(F.hash("text").alias("h")).distinct().count() == 1
    want = brute([r[1].encode() for r in rows], 200)
    got = find(docs, hot_rows=hot_rows).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(r[0]), *w[:4]) for r, w in zip(rows, want))
    assert sorted(r.text for r in remove(docs, hot_rows=hot_rows).collect()) == sorted(w[4].decode() for w in want)


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(1)
    for size in (2, 3, 40):
        parts = [bytes(rng.randrange(size) + 97 for _ in range(rng.randint(8, 60))) for _ in range(30)] + [b"a" * 50, b"ba" * 20, bytes(range(250, 100, -1)), b"\0" * 20]
        raw = b"\0".join(parts) + b"\0" * 8
        text = np.frombuffer(raw, np.uint8)[:len(raw) - 7]
        sizes = np.array([len(p) for p in parts])
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        end, length = start + sizes, 8
        order = suffix_order(text, raw, start, end, sizes - length + 1, length).tolist()
        stop = {p: e for s, e in zip(start.tolist(), end.tolist()) for p in range(s, e)}
        keys = [raw[p:min(p + length, stop[p])] for p in order]
        assert keys == sorted(keys)
        assert {p for s, n in zip(start.tolist(), sizes.tolist()) for p in range(s, s + n - length + 1)} <= set(order)
        assert len(order) == len(set(order))


@pytest.mark.parametrize("length", [3, 8, 21])
def test_repeated_windows(length):
    rng = random.Random(length)
    parts = [bytes(rng.randrange(2) + 97 for _ in range(rng.randint(length, 40))) for _ in range(12)] + [b"z" * (length + 3), b"q" * length]
    count = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
    got = repeated(parts, length)
    assert [f.tolist() for f in got] == [[count[p[i:i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]


def test_empty(empty):
    assert find(empty).count() == 0 and remove(empty).count() == 0
