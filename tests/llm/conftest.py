import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, component_id long, size int, line string"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows and ids, clashing column names."""
    rng = random.Random(4)
    long = words(rng, 30000)
    base = words(rng, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " extra", None, None), (4, None, "fr", "b"), (5, "", "fr", "b"), (6, "   \n\t ", None, "b"),
        (7, long, "en", "a"), (None, base, "en", None), (None, None, None, None), (8, "1234 5678 !!", "de", "c"), (9, "é à ü ß\nßtraße", "de", "c"),
        (10, words(rng, 40) + "\n" + base, "en", "a"), (10, words(rng, 40), "en", "a"), (11, base, "en", "a"), (11, base, "en", "a"), (12, "x", "en", "ü"),
    ]
    return [(i, t, lang, s, None, None, None, None, None, None) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
