import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, component_id string, k string, t int, size string, h double, score string"


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names clash with what operators make."""
    full = [(*r, len(r[1] or ""), 7, "x", "y", 3, "z", 0.5, "s") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, prose(1, 300), "en", "a"),
    (1, prose(1, 300), "en", "a"),
    (2, prose(1, 300), "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "en", None),
    (6, "Ümlaut 中文 ١٢ a\0b <|endoftext|> '' it's", "xx", "b"),
    (7, prose(7, 60_000), "en", "a"),
    (8, "one two", "en", "b"),
    (9, "word " * 500, None, "b"),
    (None, prose(3, 100), "de", "c"),
    (10, prose(1, 300).replace("w5", "w6", 1), "en", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES).cache()


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
