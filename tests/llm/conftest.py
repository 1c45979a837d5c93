import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _sh_fp string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and blank texts, copies, near copies, repeated rows and a long text."""
    import random

    rng = random.Random(5)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "é ÉÀ ß 漢字 Abc ABC"), (104, base[3]), (105, base[3].upper()), (106, base[4] + " zz"), (107, words(rng, 9000)), (108, "one"), (109, "a a a a " * 40)]
    passage = words(rng, 60, 5000)
    rows += [(110 + i, words(rng, 30, 5000) + " " + passage + " " + words(rng, 30, 5000)) for i in range(5)]
    rows += [(7, base[7]), (None, base[8]), (None, None)]
    sources = ["a", "b", "c", None, "a"]
    return [(i, t, "en", sources[k % 5], len(t or ""), k, 0.5, "x") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
