from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_rows import ROWS  # noqa: E402

@pytest.fixture(scope="session")
def docs(spark):
    """The rows above with extra columns, some named like results."""
    return spark.createDataFrame(
        [(i, t, "en", None if i == 5 else f"s{(i or 0) % 3}", 0, "extra", True) for i, t in ROWS],
        "doc_id long, text string, lang string, source string, n_words long, removed string, kept boolean",
    )


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
