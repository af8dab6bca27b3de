"""The shape of plans that has to hold at any size."""

from __future__ import annotations

import pytest

from shared_rows import SF_DIR
from gleaner.operators import lookup
from gleaner.operators.bm25 import bm25_hits
from gleaner.operators.requests import resolved_batch
from gleaner.operators.vector import vector_hits
from workload import searches, tables as _tables  # noqa: F401
from workload.registry import QUERIES, requests_for, store


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scores_are_summed_without_a_shuffle(spark):
    opened = store(spark, SF_DIR)
    rows = requests_for(spark, SF_DIR, searches.KEYWORD_BATCH).collect()
    text = plan(bm25_hits(resolved_batch(spark, rows, opened.companies), opened))
    assert "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in text and text.index("WindowGroupLimit") < text.index("HashAggregate")


def test_query_terms_reach_the_scan(spark):
    opened = store(spark, SF_DIR)
    rows = requests_for(spark, SF_DIR, searches.KEYWORD).collect()
    text = plan(bm25_hits(resolved_batch(spark, rows, opened.companies), opened))
    assert "PushedFilters: [In(term, [license,nicht,thble])" in text


@pytest.mark.parametrize("name", ["bm25_single", "vector_single", "hybrid_batch", "substring_batch"])
def test_labels_prune_partitions(spark, name, monkeypatch):
    monkeypatch.setattr("gleaner.operators.ranking.NAMED_HITS", 0)
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "dynamicpruning" in text


@pytest.mark.parametrize("name", ["bm25_single", "vector_single", "hybrid_single"])
def test_labels_of_few_hits_are_named_in_the_scan(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "chunk_text" in line]
    assert pushed and all("In(chunk_id" in line and "part#" in line for line in pushed)


def test_no_search_multiplies_its_sides(spark, monkeypatch):
    monkeypatch.setattr("gleaner.operators.ranking.NAMED_HITS", 0)
    for name in QUERIES:
        if name.startswith(("bm25", "vector", "hybrid", "substring", "compare", "documents", "companies")):
            text = plan(QUERIES[name](spark, SF_DIR))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_company_filters_reach_the_vector_scan(spark):
    opened = store(spark, SF_DIR)
    rows = requests_for(spark, SF_DIR, searches.VECTOR_FILTERED).collect()
    text = plan(vector_hits(resolved_batch(spark, rows, opened.companies), opened))
    assert "In(cik, [0,17,3])" in text


def test_lookups_cut_to_the_limit_while_sorting(spark, tables):
    text = plan(lookup.find_documents(tables, year=2019))
    assert "TakeOrderedAndProject" in text
