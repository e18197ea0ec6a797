import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Seeded texts of words from a small vocabulary."""

    def make(seed: int, words: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))

    return make


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, source]) rows, with columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7, 1.0, 2, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, n_chars long, score double, start int, kind string")

    return make
