"""The inverted file against exact search: recall, and how many vectors are read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plan_rows import rows_read
from gleaner.functions.codes import Coder, best_possible
from gleaner.operators import ivf
from gleaner.operators.requests import request_frame, resolved_batch
from gleaner.operators.vector import unit_queries, vector_hits
from gleaner.plans.store import _VECTORS_PER_PAGE, Store
from gleaner.schemas import CHUNKS, EMBEDDINGS

CHUNK_COUNT = 6000


def vectors_of(kind: str, dimensions: int) -> np.ndarray:
    draw = np.random.default_rng(dimensions)
    if kind == "narrow":
        means = draw.normal(size=(60, dimensions))
        return means[draw.integers(60, size=CHUNK_COUNT)] + 0.1 * draw.normal(size=(CHUNK_COUNT, dimensions))
    if kind == "groups":
        means = draw.normal(size=(60, dimensions)) * 2
        return means[draw.integers(60, size=CHUNK_COUNT)] + draw.normal(size=(CHUNK_COUNT, dimensions))
    return draw.normal(size=(CHUNK_COUNT, dimensions))


def store_of(spark, tables, vectors, path) -> Store:
    ids = spark.range(len(vectors), numPartitions=4).withColumn("chunk_id", F.format_string("k%06d", "id"))
    chunks = ids.select("chunk_id", F.lit("s1").alias("section_id"), F.lit("d1").alias("doc_id"), F.lit("t").alias("chunk_text"), F.lit(1).alias("chunk_length"))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    given = {
        **tables,
        CHUNKS: chunks.toDF(*tables[CHUNKS].columns),
        EMBEDDINGS: ids.join(rows, "id").select("chunk_id", "embedding"),
    }
    return Store(spark, given, str(path))


@pytest.mark.parametrize(("kind", "dimensions"), [("groups", 64), ("groups", 1536), ("even", 64)])
def test_recall_and_reading(spark, tables, tmp_path, kind, dimensions):
    vectors = vectors_of(kind, dimensions)
    opened = store_of(spark, tables, vectors, tmp_path)
    asked = vectors[::600] + 0.3 * np.random.default_rng(1).normal(size=vectors[::600].shape)
    rows = [{"request_id": str(n), "query": "v", "query_vec": v.tolist(), "limit": 10} for n, v in enumerate(asked)]
    batch = resolved_batch(spark, request_frame(spark, rows).collect(), opened.companies)
    exact = {(r["request_id"], r["chunk_id"]) for r in vector_hits(batch, opened).collect()}
    near = {(r["request_id"], r["chunk_id"]): r["distance"] for r in ivf.ivf_hits(batch, opened).collect()}
    assert len(exact & set(near)) >= 0.9 * len(exact)
    queries = unit_queries(batch, dimensions)
    for (request, chunk), distance in near.items():
        v = np.float32(vectors[int(chunk[1:])]).astype(float)
        assert abs(distance - (1 - queries[int(request)] @ v / np.linalg.norm(v))) < 1e-9
    stored = ivf.inverted_file(opened)
    assert stored.rows.count() == len(vectors)
    assert (stored.probes <= 0.2 * len(stored.centroids)) == (kind == "groups")
    # one request: whole vectors are read of a small part, codes of the probed lists alone
    one = batch.where(lambda row: row["request_id"] == "0")
    found = ivf.ivf_hits(one, opened)
    found.collect()
    # where neighbours lie anywhere, each re-ranked row costs a page, whatever the number of vectors
    most = 0.1 * len(vectors) if kind == "groups" else 10 * ivf.OVERFETCH * _VECTORS_PER_PAGE
    assert 0 < rows_read(found, "embedding") <= most
    codes = ivf.ivf_candidates(one, stored, queries[:1], None, ivf.OVERFETCH)
    codes.collect()
    if kind == "groups":
        assert 0 < rows_read(codes, "code") <= 0.2 * len(vectors)


def test_bounds_leave_lists_unread(spark, tables, tmp_path):
    vectors = vectors_of("narrow", 64)
    opened = store_of(spark, tables, vectors, tmp_path)
    for limit, given in ((10, {}), (3, {"max_distance": 0.05}), (100, {})):
        rows = [{"request_id": "r", "query": "v", "query_vec": vectors[7].tolist(), "limit": limit, **given}]
        batch = resolved_batch(spark, request_frame(spark, rows).collect(), opened.companies)
        key = lambda frame: sorted((r["rank"], r["chunk_id"], round(r["distance"], 9)) for r in frame.collect())
        found = ivf.bounded_vector_hits(batch, opened)
        assert key(found) == key(vector_hits(batch, opened))
        assert rows_read(found, "embedding") < 0.2 * len(vectors)


def test_no_list_offers_more_than_its_bound():
    draw = np.random.default_rng(4)
    for spread in (0.01, 0.3, 3.0):
        centroids = draw.normal(size=(5, 8))
        centroids /= np.linalg.norm(centroids, axis=1)[:, None]
        rows = centroids[draw.integers(5, size=400)] + spread * draw.normal(size=(400, 8))
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        home = np.argmax(rows @ centroids.T, axis=1)
        least = np.array([(rows @ centroids.T)[home == k, k].min(initial=1.0) for k in range(5)])
        queries = draw.normal(size=(50, 8))
        queries /= np.linalg.norm(queries, axis=1)[:, None]
        bounds = best_possible(queries, centroids, least)
        assert ((queries @ rows.T) <= bounds[:, home] + 1e-9).all()


def test_odd_requests_and_tables(spark, store, tables, tmp_path):
    rows = [
        {"request_id": "a", "query": "v", "query_vec": [1.0, 0.1], "limit": 3},
        {"request_id": "zero", "query": "v", "query_vec": [0.0, 0.0]},
        {"request_id": "near", "query": "v", "query_vec": [0.0, 1.0], "max_distance": 0.2},
        {"request_id": "company", "query": "v", "query_vec": [0.0, 1.0], "ciks": ["2"]},
        {"request_id": "none", "query": "v"},
    ]
    found = ivf.vector_search_ivf(request_frame(spark, rows), store, probes=100, overfetch=20).collect()
    ids = {r: [h["chunk_id"] for h in sorted(found, key=lambda h: h["rank"]) if h["request_id"] == r] for r in ("a", "zero", "near", "company", "none")}
    assert ids == {"a": ["c1", "c2", "c5"], "zero": [], "near": ["c3"], "company": ["c3", "c7"], "none": []}
    empty = Store(spark, {**tables, EMBEDDINGS: tables[EMBEDDINGS].limit(0)}, str(tmp_path))
    assert ivf.vector_search_ivf(request_frame(spark, rows), empty).collect() == []


@pytest.mark.parametrize("dimensions", [1, 7, 64])
def test_codes(dimensions):
    draw = np.random.default_rng(2)
    units = draw.normal(size=(500, dimensions))
    units /= np.linalg.norm(units, axis=1)[:, None]
    coder = Coder(dimensions, 3)
    packed, factors = coder.encode(units)
    assert packed.shape == (500, (dimensions + 1) // 2)
    estimate = (units[:20] @ coder.rotation) @ coder.decode(packed).T / factors
    assert np.abs(estimate - units[:20] @ units.T).mean() < 0.05
