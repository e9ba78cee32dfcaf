import pytest

LONG = "lorem ipsum dolor sit amet " * 12_000
# Null and empty texts, ties, repeated rows, a very long text, other scripts, columns whose names clash with inner ones.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here"), (2, "the quick brown fox jumps over the lazy dog and runs away from here"),
    (3, None), (4, ""), (5, "   "), (6, "One"), (7, "Öl für die Straße, 雪の日 and more words to follow here"), (8, LONG),
    (9, "the quick brown fox jumps over the lazy dog and runs away from there"), (9, "the quick brown fox jumps over the lazy dog and runs away from there"),
    (None, "a document without an id that still has words in it"), (11, "a  b   c\n\n d \t e"), (12, "😀 emoji 😀 and text"),
]
EXTRA = "lang string, source string, n_chars long, score double, node string, part int, spans string, words int, found string, hash long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents that are odd in every way at once."""
    rows = [(i, t, "en", None, len(t or ""), 0.5, "n", 1, "s", 2, "f", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    """The same table without rows."""
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
