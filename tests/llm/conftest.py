import pytest

LONG = "Strand wither 12 of the long row. " * 6000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "One small text, with words enough for a window of five."),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, "One small text, with words enough for a window of five."),
        (5, "One small text, with words enough for a window of five."),
        (None, "A text without a name of its own, but with words."),
        (7, LONG),
        (8, "Ünïcode ÀB 日本語 \U0001f600  two  blanks\n\nand <|endoftext|> don't 1234"),
        (9, "a b"),
    ]
    return spark.createDataFrame(
        [(i, t, "x", 1.5, "y", False, 3) for i, t in rows],
        "doc_id long, text string, key string, score double, spans string, kept boolean, n_shingles int",
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
