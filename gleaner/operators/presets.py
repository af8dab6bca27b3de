"""One-query forms of the searches, with the defaults of the simple client methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gleaner.operators.bm25 import bm25_search
from gleaner.operators.hybrid import hybrid_search
from gleaner.operators.requests import request_frame, split_requests
from gleaner.operators.vector import vector_search
from gleaner.plans.store import Store

SIMPLE_LIMIT = 20


def _one(store: Store, query: str, limit: int, query_vec: Sequence[float] | None) -> DataFrame:
    """A request table of one row, or of none when the query is blank."""
    row = {"request_id": "0", "query": query.strip(), "limit": limit, "query_vec": query_vec}
    valid, _ = split_requests(request_frame(store.spark, [row]))
    return valid


def simple_search(store: Store, query: str, limit: int = SIMPLE_LIMIT) -> DataFrame:
    return bm25_search(_one(store, query, limit, None), store)


def simple_vector_search(
    store: Store, query: str, query_vec: Sequence[float], limit: int = SIMPLE_LIMIT
) -> DataFrame:
    return vector_search(_one(store, query, limit, query_vec), store)


def simple_hybrid_search(
    store: Store, query: str, query_vec: Sequence[float], limit: int = SIMPLE_LIMIT
) -> DataFrame:
    return hybrid_search(_one(store, query, limit, query_vec), store)
