import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text[, source]) rows."""
    return lambda rows: spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A folder with the given tables as Parquet."""

    def store(**tables):
        d = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return store
