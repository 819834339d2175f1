import pytest


@pytest.fixture
def docs(spark):
    """Awkward documents: nulls anywhere, empty and long texts, repeated rows, and columns with names that clash."""
    long = " ".join(f"w{k * k % 9973}" for k in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "a", 1),
        (2, None, "en", "a", 2),
        (3, "", None, None, 3),
        (None, "a text without a number of its own", "en", "b", 4),
        (None, None, None, None, 5),
        (4, long, "en", "b", 6),
        (5, "  \n\t \x0b ", "fr", "", 7),
        (6, "déjà vu ÄÖÜ ß   wide space 😀 emoji", "fr", "c", 8),
        (6, "déjà vu ÄÖÜ ß   wide space 😀 emoji", "fr", "c", 8),
        (7, "x", "en", "a", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    names = ["value", "key", "band", "size", "fp", "shard", "toxic", "rank", "_seq", "count", "path", "target"]
    for n in names:
        df = df.withColumn(n, df.n_chars)
    return df


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
