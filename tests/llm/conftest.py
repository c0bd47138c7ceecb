import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def thue_morse():
    """Two different strings of n letters that no polynomial modulo 2**64 tells apart."""

    def pair(n):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)

    return pair


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """documents of (doc_id, text), with an extra column whose name clashes with names that operators use inside."""
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _row string, label int, key string")
