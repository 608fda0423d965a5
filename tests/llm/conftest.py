import pytest

CASES = [(1, "the cat sat on the mat with a hat and the cat sat on the mat with a hat again today here now then so on"),
         (2, None), (3, ""), (4, "  \n "), (5, "one"), (6, "long " * 30000), (7, "long " * 30000),
         (8, "é" * 50 + " token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end"), (8, "other text of a repeated id"),
         (9, "the cat sat on the mat with a hat and the cat sat on the mat with a hat again today here now then so on"),
         (None, "a text without an id"), (10, "Released under the MIT License. Licensed under CC BY-NC 4.0, Apache License, Version 2.0")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, 1, "x", "y", 0, 0) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, node int, spans string, shard string, n int, place int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
