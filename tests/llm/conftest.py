import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import llm_fixtures  # noqa: E402


@pytest.fixture(scope="session")
def documents():
    return llm_fixtures.rows()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return llm_fixtures.frame(spark, documents)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
