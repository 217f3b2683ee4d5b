import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (id, text, lang, source) rows, with columns of clashing names."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)
        if extra:
            for name in ("id", "n", "size", "rank", "root", "label", "number", "start", "at", "block", "target", "copies", "blob", "kind"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return build


@pytest.fixture(scope="session")
def vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rep", T.StringType())])
    return lambda rows: spark.createDataFrame([(i, v, "x") for i, v in rows], schema)
