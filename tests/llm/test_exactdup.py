import hashlib
import random
import re
from collections import defaultdict

import pytest

from timelens.llm import exactdup

from .conftest import SCHEMA, prose, row


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(rb"[\x20\x09-\x0D]+", b" ", (r[1] or "").encode())].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha, kept = hashlib.sha256(text).hexdigest(), False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), not kept, sha, len(text)))
            kept = True
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    rng = random.Random(3)
    long = prose(rng, 3000)
    more = [row(200, long), row(201, long.replace(" ", "\n\t")), row(202, long[:-1] + "#"), row(203, long + " "), row(None, long), row(205, " " * 5000), row(206, " "),
            row(207, " a b"), row(208, " a b"), row(209, "a b "), row(210, "a b"), row(211, "\x00"), row(212, "\x00\x00"), row(213, "a  b")]
    return edge_rows + more + [row(300 + i, "same words here") for i in range(60)] + [row(400 + i % 2, "hot" + "\n" * (i % 3 + 1) + "text") for i in range(40)]


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 64, "held_bytes": 300}, {"modulus": 251, "chunk_bytes": 128}])
def test_groups_are_those_of_equal_texts(ready_spark, rows, settings):
    """Also where every length has few fingerprints, so that texts must be told apart by their bytes."""
    docs = ready_spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(exactdup.group(docs, **settings)) == expected(rows)


def test_different_texts_of_one_fingerprint(ready_spark):
    """Several texts a fingerprint, several copies each, of one and of many chunks."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef") for _ in range(40)) for _ in range(9)]
    rows = [row(i, rng.choice(texts)) for i in range(120)]
    docs = ready_spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(exactdup.group(docs, modulus=3, chunk_bytes=16, held_bytes=500)) == expected(rows)


def test_empty(empty):
    assert exactdup.group(empty).count() == 0


def test_chunks_combine_to_the_whole():
    rng = random.Random(1)
    raw = rng.randbytes(5000)
    for size in (1, 7, 100, 4999, 5000):
        parts = [raw[i:i + size] for i in range(0, len(raw), size)]
        assert exactdup.combine([(len(p), exactdup.fingerprint(p)) for p in parts]) == exactdup.fingerprint(raw)


def test_normalise_is_the_pattern():
    rng = random.Random(2)
    for _ in range(500):
        raw = "".join(rng.choice(" \t\n\x0b\x0c\r\x85  \x1cab") for _ in range(rng.randint(0, 9))).encode()
        assert exactdup.normalise(raw) == re.sub(rb"[\x20\x09-\x0D]+", b" ", raw)


def test_modulus_is_prime():
    n = exactdup.MODULUS
    assert n.bit_length() == 127 and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11, 13))
