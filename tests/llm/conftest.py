import random

import pytest



@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, near copies, ties and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Été", "über", "it's", "日本", "x1", "password: hunter22", "\n", "a,b"]
    body = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    shared = " ".join(f"shared{k}" for k in range(70))
    texts = [None, "", " \t\n", "one", "four words are here", *body, shared, shared + " tail", "head " + shared, body[0], body[0] + " z", "a" * 3000, "ab " * 20_000, shared]
    rows = [(k, t, "x", float(k)) for k, t in enumerate(texts)]
    rows += [rows[7], (None, "no id " + shared, "x", 0.0), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, count double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
