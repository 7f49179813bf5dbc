import pytest

from larkspan.session import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture()
def documents(spark):
    """A table with extra columns whose names clash with inner ones, from (doc_id, text) rows."""

    def make(rows):
        schema = "doc_id long, text string, _text string, doc string, row string, node string, digest string, m string, cell string"
        return spark.createDataFrame([(i, t, "w", "x", "y", "z", "d", "m", "c") for i, t in rows], schema)

    return make
