import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns whose names the operators use inside."""
    def make(pairs, lang="en", extra=()):
        schema = T.StructType(DOCUMENTS.fields + [T.StructField(name, T.StringType()) for name in extra])
        return spark.createDataFrame([(i, t, lang, "src1", None if t is None else len(t), *["x"] * len(extra)) for i, t in pairs], schema)
    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    """A table of the given texts, small enough for brute force, whole texts."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
