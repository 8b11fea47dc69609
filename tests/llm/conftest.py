import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
#: Extra columns whose names operators use themselves.
CLASH = ("keep_id", "kept", "component_id", "size", "target", "taken", "score", "spans", "_id", "_text", "_n", "_key")


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source]) as a table with clashing extra columns."""

    def build(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(*r, None)[:3] if len(r) < 3 else r for r in rows], DOCS)
        return df.withColumns({c: F.lit("other") for c in CLASH})

    return build
