import pytest


@pytest.fixture
def frame(spark):
    """Builds a DataFrame of documents; further columns may clash with the operators' own."""

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build
