import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """All documents of the smallest scale, as a list of rows and as a frame."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    return frame, frame.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, equal rows and columns that clash with results."""
    long = "word " * 30_000 + "token=abcdef123456"
    rows = [
        (1, "", "en", "s", 0), (2, None, None, None, None), (None, "same text here", "en", "s", 1), (None, None, None, None, None),
        (3, "same text here", "en", "s", 1), (3, "same text here", "en", "s", 1), (4, "same  text\there", "en", "s", 1), (5, long, "xx", "s", 9),
        (6, "  \n\t ", "de", "", 3), (7, "One two three four five.\nOne two three four five.\n", "en", "t", 4), (8, "ßüß idiot 漢字 é \U0001f600", "fr", "t", 5),
    ]
    rows = [(*r, 0, "x", True, 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, fp string, kept boolean, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
