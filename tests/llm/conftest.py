import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from texts, or (doc_id, text) pairs; with clashing extra columns."""

    def make(rows):
        full = [(*(r if isinstance(r, tuple) else (i, r)), "en", "src0", 1, "x", 5) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, n long")

    return make
