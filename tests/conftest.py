from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from gleaner.plans.store import Store  # noqa: E402
from gleaner.schemas import (  # noqa: E402
    CHUNKS,
    COMPANIES,
    DOCUMENTS,
    EMBEDDINGS,
    SECTIONS,
    TABLE_SCHEMAS,
    TICKERS,
)
from gleaner.session import local_session  # noqa: E402
from shared_rows import CHUNK_ROWS, COMPANY_ROWS, DOCUMENT_ROWS, SECTION_ROWS, VECTOR_ROWS  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    def frame(name, rows):
        return spark.createDataFrame(rows, TABLE_SCHEMAS[name])

    ingested = datetime(2024, 1, 1, 12, 30)
    return {
        COMPANIES: frame(COMPANIES, COMPANY_ROWS),
        TICKERS: frame(TICKERS, [(0, 1, "AAA", "Alpha")]),
        DOCUMENTS: frame(
            DOCUMENTS,
            [(d, c, f"{c}_{y}.json", y, "p", 1, 10, ingested, "v1") for d, c, y in DOCUMENT_ROWS],
        ),
        SECTIONS: frame(SECTIONS, [(s, d, 1, f"name {s}", "text") for s, d in SECTION_ROWS]),
        CHUNKS: frame(CHUNKS, [(c, s, d, t, len(t)) for c, s, d, t in CHUNK_ROWS]),
        EMBEDDINGS: frame(EMBEDDINGS, VECTOR_ROWS),
    }


@pytest.fixture(scope="session")
def store(spark, tables, tmp_path_factory):
    return Store(spark, tables, str(tmp_path_factory.mktemp("store")))
