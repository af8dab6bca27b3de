from __future__ import annotations

import json

import pytest

from gleaner.operators import summary
from gleaner.operators.hybrid import hybrid_search
from gleaner.operators.requests import request_frame
from gleaner.schemas import DOCUMENTS, RESULT_COLUMNS
from gleaner.sources import sinks

SCHEMA = (
    "request_id string, rank int, method string, chunk_id string, doc_id string, cik string, "
    "company_name string, filename string, section_name string, chunk_text string, char_count int, "
    "fts_score double, vector_score double, distance double, combined_score double"
)


def _hit(rank, company, cik, fts, vector, combined, text="t", request="r"):
    return (request, rank, "hybrid", f"c{rank}", "d1", cik, company, "f", "s", text, 1, fts, vector, None, combined)


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [
            _hit(1, "A", "1", 1.0, 0.5, 0.9),
            _hit(2, "B", "2", 0.5, 0.0, 0.4),
            _hit(3, None, "3", 0.0, 0.7, 0.3, text="x" * 400),
            _hit(4, "A", "1", 0.0, 0.0, 0.0),
            _hit(5, "", "3", None, 0.2, None),
        ],
        SCHEMA,
    )


@pytest.fixture
def requests(spark):
    return request_frame(spark, [{"request_id": "r", "query": "q"}, {"request_id": "empty", "query": "z"}])


def test_composition(results, requests):
    rows = {row["request_id"]: row for row in summary.composition(results, requests).collect()}
    row = rows["r"]
    assert (row["total_results"], row["fts_only"], row["vector_only"], row["both_methods"]) == (5, 1, 2, 1)
    assert row["combined_score_avg"] == pytest.approx(1.6 / 5)
    assert (row["combined_score_min"], row["combined_score_max"]) == (0.0, 0.9)
    assert [tuple(e) for e in row["company_distribution"]] == [("3", 2), ("A", 2), ("B", 1)]
    assert rows["empty"]["total_results"] == 0 and rows["empty"]["fts_only"] is None


def test_distribution_forms(results, requests):
    composed = summary.composition(results, requests).where("request_id = 'r'")
    row = composed.select(
        summary.distribution_map(composed["company_distribution"]).alias("m"),
        summary.distribution_text(composed["company_distribution"]).alias("t"),
    ).first()
    assert row["m"] == {"3": 2, "A": 2, "B": 1} and row["t"] == "3=2; A=2; B=1"
    listed = summary.company_distribution(results).collect()
    assert [(r["company"], r["hits"]) for r in listed] == [("3", 2), ("A", 2), ("B", 1)]


def test_search_summary(results, requests):
    rows = {row["request_id"]: row for row in summary.search_summary(results, requests).collect()}
    row = rows["r"]
    assert (row["results_found"], row["fts_only"], row["vector_only"], row["both_methods"]) == (5, 1, 2, 1)
    assert row["avg_similarity"] == pytest.approx(1.4 / 5)
    assert rows["empty"]["results_found"] == 0 and rows["empty"]["avg_combined_score"] is None


def test_envelope_and_sink(spark, results, requests, tmp_path):
    nested = summary.envelope(results, requests, "hybrid")
    rows = {row["request_id"]: row for row in nested.collect()}
    assert [item["rank"] for item in rows["r"]["results"]] == [1, 2, 3, 4, 5]
    assert rows["empty"]["total_results"] == 0 and rows["empty"]["results"] == []
    sinks.write_responses(nested, str(tmp_path / "out"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(nested.collect())
    texts = {r["request_id"]: json.loads(r["response"]) for r in sinks.response_json(nested).collect()}
    assert texts["r"]["total_results"] == 5 and texts["r"]["results"][0]["chunk_id"] == "c1"


def test_reader_views(results, tables):
    cards = {row["rank"]: row for row in summary.result_cards(results).collect()}
    assert cards[3]["company"] == "Unknown Company" and cards[3]["excerpt"] == "x" * 300 + "..."
    legacy = {row["rank"]: row for row in summary.legacy_results(results, tables[DOCUMENTS]).collect()}
    assert legacy[1]["search_score"] == 0.9 and legacy[1]["year"] == 2019
    assert legacy[3]["company_name"] == "Unknown" and legacy[5]["company_name"] == "Unknown"
    # A score of 0 is passed over, down to the vector score.
    assert legacy[4]["search_score"] == 0.0 and legacy[5]["search_score"] == 0.2


def test_explanation(spark, store):
    asked = request_frame(
        spark,
        [
            {"request_id": "r", "query": "apple", "query_vec": [1.0, 0.0], "fts_weight": 0.2, "semantic_weight": 0.2},
            {"request_id": "none", "query": "zebra"},
        ],
    )
    rows = {row["request_id"]: row for row in summary.explain_hybrid(asked, store).collect()}
    row = rows["r"]
    assert (row["fts_weight"], row["normalized_fts_weight"]) == (0.2, 0.5)
    assert (row["fts_results"], row["vector_results"], row["combined_unique"]) == (3, 5, 6)
    assert row["step_4"] == "Returned top 6 results" and row["results_found"] == 6
    assert rows["none"]["step_4"] == "Returned top 0 results" and rows["none"]["fts_results"] == 0


def test_comparison(spark, store):
    asked = request_frame(spark, [{"request_id": "r", "query": "apple", "query_vec": [1.0, 0.0], "limit": 2}])
    rows = summary.compare_methods(asked, store).collect()
    assert {row["method"] for row in rows} == {"fts", "vector", "hybrid"}
    by_chunk = {}
    for row in rows:
        by_chunk.setdefault(row["chunk_id"], []).append(row)
    assert all(row["found_by"] == len(group) for group in by_chunk.values() for row in group)
    assert set(RESULT_COLUMNS) <= set(rows[0].asDict())
    hybrid = hybrid_search(asked, store).collect()
    assert sorted(r["chunk_id"] for r in hybrid) == sorted(r["chunk_id"] for r in rows if r["method"] == "hybrid")
