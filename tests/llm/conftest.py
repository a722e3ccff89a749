import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from ``(doc_id, text)`` rows."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, an empty and a very long text, ties, repeated rows and a null id."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    same = "The Quick brown fox jumps over the lazy dog and runs away from here"
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, same), (7, same.upper()), (7, same.upper()),
        (8, words), (9, words + " tail"), (None, same), (None, None), (10, "é" * 500), (11, "1 " * 3000), (12, "a" * 5000),
    ]
