import pytest


@pytest.fixture
def docs(spark):
    """A function from texts (or (doc_id, text) pairs) to a table like documents, with clashing extra columns."""

    def make(texts):
        rows = [(*(t if isinstance(t, tuple) else (i, t)), "en", "src", None, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").withColumnRenamed("digest", "rep")

    return make
