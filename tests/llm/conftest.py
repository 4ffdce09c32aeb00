import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, m int, key string, gone long, line string, rank int, bits string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with what operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 1.0, 2, "x", 3, "y", 4, "z") for i, t in rows], DOCS).repartition(3)

    return make
