from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns whose names clash with the operators' own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("label", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("spans", T.StringType()), T.StructField("digest", T.StringType())])

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 7, None, "d") for i, t in rows], schema)

    return make
