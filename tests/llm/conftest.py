import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of texts, or of (doc_id, text) or (doc_id, text, lang, source) tuples."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else tuple(r)
            doc_id, text, lang, source = (*r, "en", "src")[:4] if len(r) == 2 else r
            full.append((doc_id, text, lang, source, len(text or "")))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
