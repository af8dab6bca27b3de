"""Lookups of request tables against the same lookups one by one."""

from __future__ import annotations

import pytest

from gleaner.operators.lookup import find_companies, find_documents
from gleaner.operators.lookup_batch import (
    COMPANY_REQUESTS,
    DOCUMENT_REQUESTS,
    find_companies_batch,
    find_documents_batch,
)
from gleaner.schemas import COMPANIES

COMPANY_ROWS = [
    ("name", "alpha", None, None, None, None),
    ("again", "alpha", None, None, None, 1),
    ("wild", "a_pha%o", None, None, None, 5),
    ("under", "alpha_one", None, None, None, 5),
    ("percent", "beta%corp", None, None, None, 5),
    ("slash", "o\\", None, None, None, 5),
    ("all wild", "%_%", None, None, None, 5),
    ("one letter", None, "a", None, None, 5),
    ("ticker", None, "bB", None, None, 5),
    ("cik", None, None, 1, None, 5),
    ("exchange", None, None, None, "NASDAQ", 5),
    ("all", "one", "aa", 1, "nasdaq", 5),
    ("nobody", "gamma", None, None, None, 5),
    ("other case", "ZERO", "", 0, "", 5),
]


def test_companies(spark, tables):
    asked = spark.createDataFrame(COMPANY_ROWS, COMPANY_REQUESTS)
    found, rejected = find_companies_batch(asked, tables[COMPANIES])
    rows = found.collect()
    assert rejected.isEmpty()
    for request, name, ticker, cik, exchange, limit in COMPANY_ROWS:
        own = [tuple(r)[2:] for r in sorted(rows, key=lambda r: r["rank"]) if r["request_id"] == request]
        one = find_companies(
            tables[COMPANIES], name=name, ticker=ticker, cik=cik, exchange=exchange, limit=limit or 50
        )
        assert own == [tuple(r) for r in one.collect()], request


def test_rejected_companies(spark, tables):
    rows = [("a", None, None, None, None, 5), ("b", "", "", 0, "", 0), (None, "x", None, None, None, 1001), ("d", "one", None, None, None, 1)]
    found, rejected = find_companies_batch(spark.createDataFrame(rows, COMPANY_REQUESTS), tables[COMPANIES])
    assert {r["request_id"]: r["reason"] for r in rejected.collect()} == {
        "a": "no filter",
        "b": "no filter; limit out of bounds",
        None: "no request id; limit out of bounds",
    }
    assert {r["request_id"] for r in found.collect()} == {"d"}


def test_no_listing_is_multiplied(spark, tables):
    asked = spark.createDataFrame(COMPANY_ROWS, COMPANY_REQUESTS)
    plan = find_companies_batch(asked, tables[COMPANIES])[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


DOCUMENT_ROWS = [
    ("ticker", ["aaa", " BBB ", "nope", ""], None, None, None),
    ("cik", None, ["1", "9"], None, 1),
    ("year", None, [], 2019, 5),
    ("both", ["aaa", "ccc"], ["3"], None, 5),
    ("all", ["aaa"], ["1"], 2019, 5),
    ("no such ticker", ["nope"], None, 2019, 5),
    ("other year", None, ["1"], 2001, 5),
]


def test_documents(spark, tables):
    asked = spark.createDataFrame([*DOCUMENT_ROWS, ("none", [""], [], 0, 5)], DOCUMENT_REQUESTS)
    found, rejected = find_documents_batch(asked, tables)
    rows = found.collect()
    assert [(r["request_id"], r["reason"]) for r in rejected.collect()] == [("none", "no filter")]
    for request, tickers, ciks, year, limit in DOCUMENT_ROWS:
        own = [tuple(r)[2:] for r in sorted(rows, key=lambda r: r["rank"]) if r["request_id"] == request]
        one = find_documents(
            tables, tickers=",".join(tickers or []), ciks=",".join(ciks or []), year=year, limit=limit or 50
        )
        assert own == [tuple(r) for r in one.collect()], request


@pytest.mark.parametrize("empty", ["requests", "companies"])
def test_empty_tables(spark, tables, empty):
    asked = spark.createDataFrame(COMPANY_ROWS, COMPANY_REQUESTS)
    companies = tables[COMPANIES]
    found, _ = find_companies_batch(asked.limit(0) if empty == "requests" else asked, companies.limit(0) if empty == "companies" else companies)
    assert found.isEmpty()
