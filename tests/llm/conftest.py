import pytest
from pyspark.sql import types as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use within.
        T.StructField("_th", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("_key_id", T.StringType()),
        T.StructField("_cuts", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
