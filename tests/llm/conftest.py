"""Tables for the operators' tests."""

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) in ascending order of doc_id."""
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
