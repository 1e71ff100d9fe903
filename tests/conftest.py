from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from doclake.session import local_session

    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs(doc_id, text, file_name, doc_type) from texts, numbered from 1."""
    def make(*texts: str, ext: str = "txt"):
        rows = [(i, t, f"in/doc_{i}.{ext}", "text_document") for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, file_name string, doc_type string")

    return make


@pytest.fixture(scope="session")
def value_of():
    """One column of the rows in document order."""
    return lambda df, column, key="doc_id": [r[column] for r in df.orderBy(key).collect()]
