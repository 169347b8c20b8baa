import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """The session; the shared folder is spark.checkpoint.dir, or a temporary one where that is unset."""
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, n int, node int"


@pytest.fixture(scope="session")
def make(shared):
    def docs(rows):
        """documents with extra columns whose names clash with those of operators; rows of (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 1, 2) for r in rows]
        return shared.createDataFrame(full, DOCS)

    return docs
