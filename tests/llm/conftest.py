import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture()
def docs(spark):
    """Rows of (doc_id, text) as a documents table with columns that could clash."""

    def make(rows):
        data = [(i, t, "en", "src0", 0, "x", 1) for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_id` string, run int"
        return spark.createDataFrame(data, schema)

    return make
