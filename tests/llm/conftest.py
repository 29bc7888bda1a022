import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, key string, size int, hash string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents that also has columns whose names the operators use themselves."""
    def make(texts, sources=None, langs=None):
        rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i), len(t) if t is not None else None, 7, "x", 1, "y") for i, t in texts]
        return spark.createDataFrame(rows, DOC)

    return make


#: Nulls, empty and blank texts, ties, repeated rows and a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "word " * 30000), (None, "no id here at all now"), (7, "naïve Straße 日本語 \x1c 😀")]


@pytest.fixture(scope="session")
def odd():
    return ODD
