import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    words = [f"w{i % 97}x{i % 13}" for i in range(4000)]
    base = " ".join(words[:120])
    rows = [
        (1, base, "en", "a", len(base), "p"),
        (2, base, "en", "b", len(base), None),
        (2, base, "en", "b", len(base), None),
        (3, base.replace("w5x5", "changed"), "en", "a", 1, "q"),
        (4, "", "en", None, 0, "q"),
        (5, None, None, None, None, None),
        (None, "alone and without an id", "de", "c", 5, "r"),
        (6, " ".join(words[200:3900]), "fr", "c", 9, "r"),
        (7, "\n \t\n", "fr", "c", 4, "r"),
        (8, "two words", "es", "b", 9, "r"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").withColumnRenamed("h", "fp")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
