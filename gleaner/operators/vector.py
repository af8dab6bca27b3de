"""Exact cosine search: one pass over the stored vectors for a whole batch of requests.

Spark's array functions evaluate a dot product element by element, so distances are computed as
one matrix product per Arrow batch. A task keeps the best rows of every request while it reads and
hands on at most 100 per request, so that is all the ranking shuffle ever moves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gleaner.functions.blocks import CANDIDATES, nearest_vectors
from gleaner.functions.vectors import similarity
from gleaner.operators.ranking import label_hits, top_ranked
from gleaner.operators.requests import Batch, in_batches
from gleaner.plans.store import Store

HITS = "request_id string, chunk_id string, distance double, vector_score double, rank int"


def unit_queries(batch: Batch, dimensions: int) -> np.ndarray:
    """The query vectors scaled to length 1, in double precision."""
    wrong = [r["request_id"] for r in batch.rows if len(r["query_vec"]) != dimensions]
    if wrong:
        raise ValueError(f"query vectors must have {dimensions} values; wrong in: {wrong[:10]}")
    matrix = np.array([r["query_vec"] for r in batch.rows], dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]


def vector_hits(batch: Batch, store: Store) -> DataFrame:
    """Ranked ``(request_id, chunk_id, distance, vector_score, rank)``; filters act before the cut."""
    batch = batch.where(lambda row: row["query_vec"] is not None)
    if not batch.rows or not store.has_vectors:
        return batch.empty(HITS)
    return exact_hits(batch, store, store.vectors(), unit_queries(batch, store.dimensions()))


def exact_hits(batch: Batch, store: Store, vectors: DataFrame, queries: np.ndarray) -> DataFrame:
    """The nearest of some vectors for requests that all have a query."""
    ciks = batch.filtered_ciks
    if ciks is not None:
        vectors = vectors.where(F.col("cik").isin(ciks))
    # A maximum of 0 means none was asked for.
    cutoffs = [row["max_distance"] or None for row in batch.rows]
    search = nearest_vectors(*batch.columns(cutoffs), queries)
    candidates = (
        vectors.select("chunk_id", "cik", "embedding", "norm")
        .mapInArrow(search, CANDIDATES)
        .withColumnRenamed("cost", "distance")
    )
    return (
        top_ranked(
            candidates.join(F.broadcast(batch.frame.select("request_id", "limit")), "request_id"),
            F.col("key"),
            F.col("chunk_id"),
            limit=F.col("limit"),
            tasks=store.vector_tasks(),
        )
        .withColumn("vector_score", similarity(F.col("distance")))
        .select("request_id", "chunk_id", "distance", "vector_score", "rank")
    )


def shown_distances(hits: DataFrame, batch: Batch) -> DataFrame:
    """Blank the distance for requests that did not ask for it."""
    wish = F.broadcast(batch.frame.select("request_id", "include_distances"))
    return (
        hits.join(wish, "request_id")
        .withColumn("distance", F.when(F.col("include_distances"), F.col("distance")))
        .drop("include_distances")
    )


def vector_search(requests: DataFrame, store: Store) -> DataFrame:
    """Exact nearest chunks for a request table; see ``RESULT_COLUMNS``."""

    def search(batch: Batch) -> DataFrame:
        return label_hits(shown_distances(vector_hits(batch, store), batch), store, "vector", batch=batch)

    return in_batches(requests, store.companies, search, shared_pass=True)
