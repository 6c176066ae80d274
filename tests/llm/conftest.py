import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from promptmill.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(folder):
    import pyarrow.parquet as pq
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
