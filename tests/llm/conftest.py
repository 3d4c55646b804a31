import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def frame(spark):
    """Documents (doc_id, text) with columns whose names the operators use inside."""

    def make(rows):
        made = spark.createDataFrame(rows, "doc_id long, text string")
        return made.selectExpr("doc_id", "text", "'x' AS lang", "1 AS cls", "2 AS key", "'k' AS label", "3 AS n_chars", "4 AS _row", "5 AS hash", "6 AS `rank`")

    return make
