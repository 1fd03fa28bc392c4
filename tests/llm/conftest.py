import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import LABELS, SCHEMA, sentence  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeats, ties, a very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (1, sentence(1), "en", "a", 10),
        (2, sentence(2), "en", "a", 10),
        (2, sentence(2), "en", "a", 10),
        (2, sentence(3), "en", "b", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", None, 4),
        (None, sentence(1), "en", "a", 10),
        (None, None, None, None, None),
        (6, sentence(1), "en", "b", 10),
        (7, long_text, "en", "c", 10),
        (8, "Ünï çödé 漢字 🙂 ▁mark  two  blanks\r\n", "en", "é", 10),
        (9, "a", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1)], LABELS)
