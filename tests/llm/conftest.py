import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts():
    """{doc_id: text} of the small table."""
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()
    return dict(rows)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "en", "test", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, long and repeated texts, null and repeated ids, and columns that other tables have too."""
    long_text = " ".join(f"word{i % 977} filler{i % 13}" for i in range(20_000))
    rows = [
        (1, None, "x", "a", 1), (2, "", "x", "b", 2), (3, " \t\n ", "x", "c", 3), (4, long_text, "x", "d", 4),
        (5, "same text here", "x", "e", 5), (5, "same text here", "x", "e", 5), (5, "other text", "x", "f", 6),
        (None, "no id", "x", "g", 7), (None, None, None, None, None), (8, long_text, "y", "h", 8),
    ]
    schema = "doc_id long, text string, item_id string, kind string, start long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
