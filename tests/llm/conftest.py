import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, score double, label int, kept boolean"


def frame(spark, texts, first=0):
    """Documents of the given texts, with further columns whose names operators use inside."""
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or ""), "x", 1, 0.5, 1, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def odd_texts():
    """Null, empty, white space, ties, repeats, one very long text, text beyond ASCII."""
    rng = random.Random(4)
    long = "\n".join(sentence(rng, 40) for _ in range(500))
    plain = sentence(rng, 120)
    return [None, "", " \t\n ", plain, plain, long, "né", "one", "a b", "日本語 のテキスト " * 40, plain + " more words"]


@pytest.fixture
def odd_docs(spark, odd_texts):
    """The odd texts, with one row repeated and one row of nulls only."""
    docs = frame(spark, odd_texts)
    twin = docs.where("doc_id = 3")
    nothing = spark.createDataFrame([(None,) * 10], SCHEMA)
    return docs.unionByName(twin).unionByName(nothing)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"
    )
