from __future__ import annotations

import pytest

from gleaner.operators import lookup
from gleaner.operators.stats import capabilities, is_empty, table_counts
from gleaner.schemas import CHUNKS, COMPANIES, DOCUMENTS, EMBEDDINGS, SECTIONS


def _tickers(frame):
    return [row["ticker"] for row in frame.collect()]


def test_company_filters(tables):
    companies = tables[COMPANIES]
    assert _tickers(lookup.find_companies(companies, name="alpha_one")) == ["AAB", "AAA"]
    assert _tickers(lookup.find_companies(companies, name="beta%corp")) == ["BBB"]
    assert _tickers(lookup.find_companies(companies, name="\\")) == ["ZZZ"]
    assert _tickers(lookup.find_companies(companies, ticker="a")) == ["AAB", "AAA"]
    assert _tickers(lookup.find_companies(companies, cik=2)) == ["BBB"]
    assert _tickers(lookup.find_companies(companies, ticker="a", exchange="nyse")) == ["AAB"]


def test_names_sort_with_nulls_last(tables):
    assert _tickers(lookup.find_companies(tables[COMPANIES], exchange="NASDAQ")) == ["AAA", "CCC"]


def test_zero_and_empty_count_as_not_given(tables):
    companies = tables[COMPANIES]
    assert _tickers(lookup.find_companies(companies, ticker="zz", cik=0, name="", exchange="")) == ["ZZZ"]
    with pytest.raises(ValueError, match="at least one"):
        lookup.find_companies(companies, cik=0)
    with pytest.raises(ValueError, match="at least one"):
        lookup.find_documents(tables, year=0, tickers=" , ", ciks="")


@pytest.mark.parametrize("limit", [0, 1001])
def test_limits(tables, limit):
    with pytest.raises(ValueError, match="limit"):
        lookup.find_companies(tables[COMPANIES], ticker="a", limit=limit)


def test_documents(tables):
    def ids(**given):
        return [row["doc_id"] for row in lookup.find_documents(tables, **given).collect()]

    assert ids(tickers="aaa, bbb ,") == ["d1", "d2"]
    assert ids(tickers="aab", ciks=" 1 ,2") == ["d1"]
    assert ids(ciks="2,9,abc") == ["d2", "d4"]
    assert ids(year=2018) == ["d3"]
    assert ids(tickers="nope") == []
    assert ids(tickers="aaa", year=2018) == []
    assert ids(year=2019, limit=2) == ["d1", "d2"]


def test_document_by_id(tables):
    found = lookup.get_document(tables[DOCUMENTS], "d2").collect()
    assert [row["ingested_at"] for row in found] == ["2024-01-01 12:30:00"]
    assert lookup.get_document(tables[DOCUMENTS], "nope").count() == 0


def test_presets_and_drilldown(tables):
    companies, documents = lookup.ticker_drilldown(tables, "aaa")
    assert _tickers(companies) == ["AAA"] and [r["doc_id"] for r in documents.collect()] == ["d1"]
    companies, documents = lookup.ticker_drilldown(tables, "xyz")
    assert companies.count() == 0 and documents.count() == 0
    assert lookup.company_by_cik(tables[COMPANIES], 1).count() == 1
    assert lookup.documents_by_cik(tables, "9", 2019).count() == 1


def test_companies_with_documents(tables):
    assert sorted(_tickers(lookup.companies_with_documents(tables))) == ["AAA", "AAB", "BBB", "CCC"]


def test_company_sections_and_browse(tables):
    assert [r["section_name"] for r in lookup.company_sections(tables, "1").collect()] == ["name s1"]
    assert lookup.browse(tables[SECTIONS], 2).count() == 2


def test_counts(spark, tables):
    row = table_counts(spark, {k: v for k, v in tables.items() if k != SECTIONS}).first()
    assert (row["documents"], row["sections"], row["chunks"], row["embeddings"]) == (4, 0, 9, 9)
    found = capabilities(spark, {CHUNKS: tables[CHUNKS]}).first()
    assert found["fts_available"] and found["hybrid_available"] and not found["vector_available"]
    assert found["vector_dimensions"] is None
    assert not is_empty(tables[EMBEDDINGS]) and is_empty(tables[EMBEDDINGS].limit(0))
