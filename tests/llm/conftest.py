import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    r = random.Random(3)
    long = " ".join(r.choice("the mit license under apache version 2 cc by nc alpha Beta token".split()) for _ in range(30_000))
    rows = [
        (1, "Released under the MIT License.", "en", "score", 1),
        (1, "Released under the MIT License.", "en", "score", 1),
        (2, None, None, None, None),
        (None, "cc-by-nc and CC BY NC", None, None, 3),
        (None, None, None, None, None),
        (3, "", "en", "x", 0),
        (4, "!!! 123 ???", "en", "x", 1),
        (5, long, "en", "x", 2),
        (6, "Apache License, Version 2 under the mit licensİe licenſe \U0001f600 日本", "fr", "x", 2),
        (7, "a b", "fr", "x", 2),
        (7, "another text of the same id", "fr", "x", 2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, labels string, score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, labels string, score int")
