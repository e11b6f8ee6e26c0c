from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """A documents table of (doc_id, text[, source, lang]) rows with columns nobody asks for, some of
    them under names that operators use inside."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, source string, lang string")
        return df.selectExpr("doc_id", "text", "source", "lang", "length(text) as n_chars", "1 as _id", "'x' as fp", "2.5 as target", "array(1) as size_", "'q' as tk")

    return make
