import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, and further columns if names and values are given."""

    def make(rows, extra=""):
        if extra:
            return spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}")
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)

    return make
