from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gleaner.operators.bm25 import bm25_hits
from gleaner.operators.hybrid import hybrid_search
from gleaner.operators.requests import request_frame, resolved_batch
from gleaner.plans.store import Store
from gleaner.schemas import CHUNKS, EMBEDDINGS
from gleaner.session import shared_folder


def _rows(spark, store):
    asked = request_frame(
        spark, [{"request_id": "r", "query": "apple cherry", "query_vec": [1.0, 0.0], "tickers": ["aaa", "bbb"]}]
    )
    found = hybrid_search(asked, store).select("rank", "chunk_id", F.round("combined_score", 9))
    return sorted(map(tuple, found.collect()))


def test_a_store_is_reopened(spark, tables, tmp_path):
    first = Store(spark, tables, str(tmp_path), reuse=True)
    expected = _rows(spark, first)
    spark.sql(f"DROP TABLE {_table_of(spark)}")
    # Nothing may be derived again: the tables the layouts came from are gone.
    bare = {**tables, CHUNKS: None, EMBEDDINGS: None}
    again = Store(spark, bare, str(tmp_path), reuse=True)
    assert _rows(spark, again) == expected
    batch = resolved_batch(spark, request_frame(spark, [{"request_id": "r", "query": "apple"}]).collect(), again.companies)
    plan = bm25_hits(batch, again)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def _table_of(spark):
    return next(t.name for t in spark.catalog.listTables() if t.name.startswith("gleaner_"))


def test_an_unfinished_layout_is_written_again(spark, tables, tmp_path):
    first = Store(spark, tables, str(tmp_path), reuse=True)
    first.passages()
    (tmp_path / "passages" / "_SUCCESS").unlink()
    assert Store(spark, tables, str(tmp_path), reuse=True).passages().count() == 9


def test_without_reuse_layouts_are_rewritten(spark, tables, tmp_path):
    Store(spark, tables, str(tmp_path)).passages()
    smaller = {**tables, CHUNKS: tables[CHUNKS].limit(2)}
    assert Store(spark, smaller, str(tmp_path)).passages().count() == 2


def test_an_empty_vector_table_offers_no_vector_search(spark, tables, tmp_path):
    empty = {**tables, EMBEDDINGS: tables[EMBEDDINGS].limit(0)}
    assert not Store(spark, empty, str(tmp_path)).has_vectors


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def _session(master, conf=None, folder=None):
    return SimpleNamespace(
        sparkContext=_Context(master, folder),
        conf=SimpleNamespace(get=lambda name, default: (conf or {}).get(name, default)),
    )


def test_shared_folder_is_the_one_the_session_names():
    named = {"spark.checkpoint.dir": "/some/shared/place/"}
    assert shared_folder(_session("spark://host", named)) == "/some/shared/place"
    assert shared_folder(_session("spark://host", folder="/set/in/code")) == "/set/in/code"


def test_only_a_local_session_makes_a_folder():
    session = _session("local[4]")
    assert shared_folder(session) == shared_folder(session)
    with pytest.raises(RuntimeError, match="shared by all executors"):
        shared_folder(_session("spark://host"))
