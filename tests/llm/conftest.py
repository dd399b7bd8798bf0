import pytest

from ampersift.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def docs(llm):
    """A function that makes a documents table from (doc_id, text) pairs, with
    columns that clash with results."""

    def make(rows):
        full = [(i, t, "en", "src", 0, "mine", 7) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score long"
        return llm.createDataFrame(full, schema)

    return make
