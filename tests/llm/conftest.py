import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with a clashing extra column from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(k, t, "x", "src", 1) for k, t in rows],
                                     "doc_id long, text string, id string, n string, component long")
    return make
