import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import common  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return common.edge_documents(spark)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return common.edge_labels(spark)
