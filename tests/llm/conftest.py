import datetime

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as a documents table, with columns that clash with operators' own."""
    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        from pyspark.sql import functions as F
        for c in extra:
            df = df.withColumn(c, F.lit(datetime.date(2020, 1, 1)))
        return df
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
