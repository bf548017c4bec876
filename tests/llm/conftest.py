import os
from pathlib import Path

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).is_dir():
        pytest.skip("no test tables here")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """All given documents as rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with results."""

    def build(rows, **extra):
        columns = "".join(f", `{name}` string" for name in extra)
        data = [(*row, *extra.values()) for row in rows]
        return spark.createDataFrame(data, f"doc_id long, text string{columns}")

    return build
