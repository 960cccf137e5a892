from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use inside.
CLASHING = ("key", "t", "id", "n", "lang_pred", "gone", "path", "n_lines_", "item", "chunk")


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table like ``documents`` from (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns."""

    def make(rows, extra=False):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        full = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        if extra:
            fields += [T.StructField(c, T.StringType()) for c in CLASHING]
            full = [(*r, *("x" * len(CLASHING))) for r in full]
        return spark.createDataFrame(full, T.StructType(fields))

    return make
