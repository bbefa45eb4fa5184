import random
import re

from timelens.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses, words

from .conftest import row

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute(text):
    ws = WORD.findall((text or "").encode().translate(LOW))
    at = [(i, label) for p, label in PHRASES for q in [p.encode().split()] for i in range(len(ws)) if ws[i:i + len(q)] == q]
    return (len(ws), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None), ",".join(sorted({x for _, x in at})))


def test_base_columns_equal_brute_force(ready_spark, edge, edge_rows):
    rng = random.Random(3)
    bits = [w for p, _ in PHRASES for w in p.split()] + ["x", "the", "License,", "CC-BY", "Ünder"]
    more = [row(1000 + i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    more += [row(1100 + i, f"{'junk ' * i}{t}. more") for i, (_, t) in enumerate(TEMPLATES)]
    df = edge.unionByName(ready_spark.createDataFrame(more, edge.schema))
    got = sorted(tuple(r)[:6] for r in scan_licenses(df.where("doc_id IS NOT NULL")).collect())
    assert got == sorted((r[0], *brute(r[1])) for r in edge_rows + more if r[0] is not None)


def test_templates_are_found(ready_spark, edge):
    texts = [row(i, f"Header text {t} and more words") for i, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in scan_licenses(ready_spark.createDataFrame(texts, edge.schema)).collect()}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and 0 < got[i].score <= 1 and got[i].spans
    cut = TEMPLATES[0][1].split()
    del cut[14:17]
    part = scan_licenses(ready_spark.createDataFrame([row(1, " ".join(cut))], edge.schema)).first()
    assert part.labels == "mit-text" and part.base_labels == "" and 0.6 < part.score < 1


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    runs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    auto = Automaton(seqs)
    text = [rng.randint(0, 4) for _ in range(400)]
    for i, (state, length) in enumerate(auto.statistics(text)):
        want = max((n for n in range(1, 13) if n <= i + 1 and tuple(text[i + 1 - n:i + 1]) in runs), default=0)
        assert length == want
        for number, end in auto.ends[state].items():
            assert seqs[number][end - length + 1:end + 1] == text[i + 1 - length:i + 1]


def test_empty(empty):
    assert scan_licenses(empty).count() == 0
    assert words(b"") == []


def test_phrases_of_one_word(ready_spark, edge):
    """Every place of the word counts, inside other phrases' runs too."""
    df = ready_spark.createDataFrame([row(1, "copyleft is copyleft under the mit license. copyleft mit license")], edge.schema)
    got = scan_licenses(df, phrases=[*PHRASES, ("copyleft", "left"), ("license", "any")]).first()
    assert (got.n_base, got.first_word, got.last_word, got.base_labels) == (7, 0, 9, "any,left,mit")
