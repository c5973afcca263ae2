import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns whose names
    clash with those the operators use inside."""
    def make(rows, clash=True):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, DOC_SCHEMA)
        if clash:
            for name in ("text_key", "h", "p", "row", "score", "items", "starts", "range", "size", "fingerprint", "label", "value"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
