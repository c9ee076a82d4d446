import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    from panelmill.llm.queries import find_package

    find_package(spark)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from ``(doc_id, text)`` pairs, with nulls in the other columns here and there."""

    def build(rows):
        full = [(d, t, None if i % 3 else "en", None if i % 4 == 1 else "s", len(t or "")) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return build
