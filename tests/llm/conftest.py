import random

import pytest

#: Columns that documents may carry and that operators use as names of their own.
CLASHES = (
    *("words", "key", "n", "cls", "label", "part", "block", "shard", "slot", "size", "nth", "place"),
    *("removed", "row", "id", "tie", "_id", "_tie", "_key", "_nth", "_again", "_text_key", "first_id"),
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    found = []
    for i in range(words):
        rank = min(int(draw.paretovariate(0.9)), vocabulary)
        found.append("".join("abcdefghij"[int(d)] for d in str(rank * 7919 % 99991)))
        if i % 23 == 22:
            found[-1] += ".\n"
    return " ".join(found).replace("\n ", "\n")


@pytest.fixture(scope="session")
def awkward():
    """Nulls in every column, empty and very long texts, ties, repeats and near copies."""
    long_text = prose(1, 6000)
    base = prose(2, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"),
        (1, " ".join(near), "en", "a"),
        (2, base, "en", "b"),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (5, " \t\n ", None, None),
        (6, long_text, "en", None),
        (7, "x" * 30000, "en", "a"),
        (8, "one two", "de", "a"),
        (9, "one two", "de", "a"),
        (9, "one two", "de", "a"),
        (None, prose(3, 80), "en", "a"),
        (None, None, None, None),
        (12, "Größe ▁ 日本語 😀 #$% a|b 12 12 12", "de", "c"),
        (13, "a b c a b c a b c\na b c\n\na b c", "en", "c"),
        (14, "THE the The tHe\r\nx\x0by", None, "c"),
        *[(20 + i, prose(50 + i, 40 + i), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(12)],
    ]
    return [(*row, None if row[1] is None else len(row[1])) for row in rows]


@pytest.fixture(scope="session")
def documents(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return documents.withColumns({name: F.lit("clash") for name in CLASHES})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return sorted((tuple(map(repr, row)) for row in frame.collect()))
