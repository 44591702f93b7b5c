"""Small tables for the operators' tests."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = schema.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make
