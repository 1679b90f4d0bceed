import pytest

#: Rows that every operator must take: nulls, empty, white space, repeated rows, equal ids, a long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 3),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 3),
    (2, None, "en", "b", None),
    (3, "", None, None, 0),
    (4, " \t\n\r\x0b\x0c ", "de", "a", 7),
    (None, "one two three", "fr", "c", 13),
    (5, "one two three", None, "c", 13),
    (6, "Über den Wölken <|endoftext|> café 日本語 😀 it's 'tis x1y2 z " * 40, "de", None, None),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "ab" * 40000, "en", "d", 80000),
    (-9, "12345 !!! ??? ###", "en", "d", 17),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns named like columns of results."""
    df = spark.createDataFrame([(*r, "x", 1.5) for r in ODD], SCHEMA + ", `key` string, score double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
