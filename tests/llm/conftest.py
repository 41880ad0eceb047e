import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tests_llm_prose import prose  # noqa: E402


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, repeated rows, one very long word, and columns named like the operators' own."""
    r = random.Random(5)
    long = prose(r, 3000)
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "   \n\t "), (5, "x" * 5000), (6, long), (7, long), (None, "a b c"), (8, "ünï çødé 😀 <|endoftext|>"), (9, long + " more words at the end")]
    return spark.createDataFrame([(*row, "d", 1, "t", None, [0], 5, 0.5, True, "k") for row in rows], "doc_id long, text string, d string, t int, v string, x string, bands array<int>, n_lines long, score double, held_out boolean, key string")


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("false")
