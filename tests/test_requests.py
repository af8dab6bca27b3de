from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.operators.bm25 import bm25_search
from gleaner.operators.requests import (
    clamp_limit,
    complement_weights,
    in_batches,
    request_frame,
    resolve_filters,
    split_requests,
    with_defaults,
)
from gleaner.schemas import COMPANIES


def _reasons(spark, row, **options):
    _, rejected = split_requests(request_frame(spark, [{"request_id": "r", "query": "q", **row}]), **options)
    found = rejected.first()
    return found["reason"] if found else None


def test_defaults(spark):
    row = request_frame(spark, [{"request_id": "r", "query": "q"}]).first()
    assert (row["limit"], row["fts_weight"], row["semantic_weight"]) == (10, 0.3, 0.7)
    assert row["normalize_scores"] is True and row["include_distances"] is True
    assert row["tickers"] is None and row["query_vec"] is None


def test_defaults_fill_missing_columns(spark):
    frame = with_defaults(spark.createDataFrame([("r", "q", None)], "request_id string, query string, limit int"))
    assert frame.first()["limit"] == 10


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ({"limit": 0}, "limit out of bounds"),
        ({"limit": 101}, "limit out of bounds"),
        ({"limit": 1}, None),
        ({"limit": 100}, None),
        ({"query": "  "}, "blank query"),
        ({"query": None}, "blank query"),
        ({"min_score": -0.1}, "min_score out of bounds"),
        ({"min_score": 0.0}, None),
        ({"max_distance": 2.1}, "max_distance out of bounds"),
        ({"max_distance": 2.0}, None),
        ({"fts_weight": 1.5}, "fts_weight out of bounds"),
        ({"semantic_weight": -1.0, "limit": 0}, "limit out of bounds; semantic_weight out of bounds"),
        ({"fts_weight": 0.0, "semantic_weight": 0.0}, None),
    ],
)
def test_bounds(spark, row, reason):
    assert _reasons(spark, row) == reason


def test_bounds_of_single_methods(spark):
    weightless = {"fts_weight": 0.0, "semantic_weight": 0.0}
    assert _reasons(spark, weightless, hybrid=True) == "combined weights must be greater than 0"
    assert _reasons(spark, {}, needs_vector=True) == "no query vector"


def test_one_knob_and_clamp(spark):
    frame = spark.createDataFrame(
        [("a", 0.25, None, 0), ("b", 0.25, 0.5, 77), ("c", None, None, None)],
        "request_id string, fts_weight double, semantic_weight double, limit int",
    )
    rows = {r["request_id"]: r for r in clamp_limit(complement_weights(frame)).collect()}
    assert rows["a"]["semantic_weight"] == 0.75 and rows["b"]["semantic_weight"] == 0.5
    assert [rows[k]["limit"] for k in "abc"] == [1, 50, 10]


def test_filters(spark, tables):
    asked = request_frame(
        spark,
        [
            {"request_id": "none", "query": "q"},
            {"request_id": "empty", "query": "q", "tickers": [], "ciks": []},
            {"request_id": "shared", "query": "q", "tickers": ["aaa", "AAB", "nope"]},
            {"request_id": "nowhere", "query": "q", "tickers": ["nope"]},
            {"request_id": "ciks", "query": "q", "ciks": ["7"]},
            {"request_id": "both", "query": "q", "tickers": ["aaa", "bbb"], "ciks": ["2", "3"]},
        ],
    )
    found = {r["request_id"]: r["allowed_ciks"] for r in resolve_filters(asked, tables[COMPANIES]).collect()}
    assert found == {
        "none": None,
        "empty": None,
        "shared": ["1"],
        "nowhere": [],
        "ciks": ["7"],
        "both": ["2"],
    }


def test_request_ids_are_unique(spark, store):
    twice = request_frame(spark, [{"request_id": "r", "query": "apple"}] * 2)
    with pytest.raises(ValueError, match="unique"):
        bm25_search(twice, store)


def test_batches_give_the_same_rows(spark, store):
    asked = request_frame(
        spark, [{"request_id": f"r{n}", "query": q} for n, q in enumerate("apple banana cherry pie".split() * 3)]
    )
    whole = bm25_search(asked, store).select("request_id", "rank", "chunk_id", F.round("fts_score", 9)).collect()

    from gleaner.operators.bm25 import bm25_hits

    sizes = []

    def search(batch):
        sizes.append(len(batch.rows))
        return bm25_hits(batch, store)

    cut = in_batches(asked, store.companies, search, max_batch=3)
    rows = cut.select("request_id", "rank", "chunk_id", F.round("fts_score", 9)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, whole))
    assert max(sizes) <= 3 and sum(sizes) == 12
