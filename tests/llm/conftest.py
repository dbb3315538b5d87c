import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text, lang, source) rows."""

    def build(*rows):
        return spark.createDataFrame([Row(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return build


@pytest.fixture
def llm_con():
    from oracle import connect

    return connect("/root/testdata/sf0.001")
