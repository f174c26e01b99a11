import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and ids repeated with other texts, columns whose names clash."""
    long = "wort " * 30_000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "   \n\t ", "x"), (4, "Hello World", "x"), (4, "Hello World", "x"), (5, "hello world", None), (None, "Hello world", "x"), (None, None, None),
        (6, long, "x"), (7, long.upper(), "x"), (8, "ÀÉ Ünï 日本 😀 " * 40, "x"), (9, "Released under the MIT License.\nmail a.b@c.de +1 (555) 123-4567", "x"), (10, "a" * 50_000, "x"), (11, "|".join("ab"), "x"),
        (12, "one two three", "x"), (12, "one two four", "x"), (12, "ONE two three", "x"),
    ]
    return spark.createDataFrame(
        [(i, t, s, "f", 1, 1, "z", 0, *"abcdefgh") for i, t, s in rows],
        "doc_id long, text string, source string, fingerprint string, score int, piece int, labels string, n_chars long, _own string, _key string, _id string, _t string, _hash string, slot string, bucket string, root string",
    )


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
