import pytest


@pytest.fixture
def rows(spark):
    """A table from tuples; documents have an extra column that clashes with results' names."""

    def make(data, schema="doc_id long, text string"):
        return spark.createDataFrame(data, schema)

    return make
