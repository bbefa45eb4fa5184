import random

import pytest
from pyspark.sql import types as T

from timelens.llm.common import ready

#: The columns of ``documents`` and some whose names the operators use for themselves.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                       T.StructField("node", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("h", T.StringType()),
                       T.StructField("id", T.StringType()), T.StructField("kept", T.StringType())])


def row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, len(text or ""), "s", 1, "l", "h", "i", "k"


def prose(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))[:size * 10]


@pytest.fixture(scope="session")
def ready_spark(spark):
    ready(spark)
    return spark


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, one very long text, copies, near copies, shared passages, ties."""
    rng = random.Random(5)
    base, passage = prose(rng, 150), prose(rng, 80)
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one two"), row(5, "one two"), row(6, "Zwei Wörter, drei", "de"), row(7, "中文没有空格的一句话", None, None),
            row(None, base), row(8, base), row(8, base), row(9, base + " tail"), row(10, base.upper()),
            row(11, prose(rng, 60) + passage + prose(rng, 20)), row(12, passage + prose(rng, 90), None), row(13, "ab" * 500), row(14, "x" * 450),
            row(15, (prose(rng, 2000) + "\n") * 12, "fr"), row(16, "line\n" * 200), row(17, "é" * 130 + "ß" * 130, "de"), row(18, "!!! ??? ..."), row(20, "12 34")]
    rows += [row(30 + i, " ".join(w if rng.random() > 0.02 else "zz" for w in base.split())) for i in range(12)]
    rows += [row(60 + i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "de"])) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def edge(ready_spark, edge_rows):
    return ready_spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(ready_spark):
    return ready_spark.createDataFrame([], SCHEMA)
