"""Company and document lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import contains_ci
from gleaner.schemas import (
    COMPANIES,
    DEFAULT_LOOKUP_LIMIT,
    DOCUMENT_COLUMNS,
    DOCUMENTS,
    MAX_LOOKUP_LIMIT,
    SECTIONS,
)
from gleaner.sources.tables import Tables


def _all_of(conditions: list[Column]) -> Column:
    if not conditions:
        raise ValueError("at least one search parameter must be provided")
    return reduce(lambda a, b: a & b, conditions)


def _checked(limit: int) -> int:
    if not 1 <= limit <= MAX_LOOKUP_LIMIT:
        raise ValueError(f"limit must be within 1..{MAX_LOOKUP_LIMIT}")
    return limit


def _listed(csv: str | None) -> list[str]:
    return [part.strip() for part in (csv or "").split(",") if part.strip()]


def find_companies(
    companies: DataFrame,
    *,
    name: str | None = None,
    ticker: str | None = None,
    cik: int | None = None,
    exchange: str | None = None,
    limit: int = DEFAULT_LOOKUP_LIMIT,
) -> DataFrame:
    """Listings matching every given parameter; empty text and 0 count as not given."""
    conditions = []
    if name:
        conditions.append(contains_ci(F.col("name"), name))
    if ticker:
        conditions.append(contains_ci(F.col("ticker"), ticker))
    if cik:
        conditions.append(F.col("cik") == cik)
    if exchange:
        conditions.append(F.upper("exchange") == exchange.upper())
    return (
        companies.where(_all_of(conditions))
        .select("cik", "name", "ticker", "exchange")
        .orderBy(F.col("name").asc_nulls_last(), F.col("ticker").asc_nulls_last())
        .limit(_checked(limit))
    )


def ciks_of_tickers(companies: DataFrame, tickers: list[str]) -> DataFrame:
    """Distinct ciks, as text, listed under any of the tickers."""
    wanted = [ticker.upper() for ticker in tickers]
    return (
        companies.where(F.upper("ticker").isin(wanted))
        .select(F.col("cik").cast("string").alias("cik"))
        .distinct()
    )


def document_metadata(documents: DataFrame) -> DataFrame:
    return documents.select(
        *[F.col(c).cast("string") if c == "ingested_at" else F.col(c) for c in DOCUMENT_COLUMNS]
    )


def documents_matching(
    tables: Tables,
    *,
    tickers: str | None = None,
    ciks: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """Documents meeting every given parameter. Tickers that lead nowhere match nothing."""
    ticker_list, cik_list = _listed(tickers), _listed(ciks)
    conditions = []
    if cik_list:
        conditions.append(F.col("cik").isin(cik_list))
    if year:
        conditions.append(F.col("year") == year)
    if not ticker_list:
        return tables[DOCUMENTS].where(_all_of(conditions))
    found = tables[DOCUMENTS]
    if conditions:
        found = found.where(_all_of(conditions))
    return found.join(ciks_of_tickers(tables[COMPANIES], ticker_list), "cik", "left_semi")


def find_documents(
    tables: Tables,
    *,
    tickers: str | None = None,
    ciks: str | None = None,
    year: int | None = None,
    limit: int = DEFAULT_LOOKUP_LIMIT,
) -> DataFrame:
    """Document metadata by comma-separated tickers, ciks and year; cik sorts as text."""
    found = documents_matching(tables, tickers=tickers, ciks=ciks, year=year)
    return (
        document_metadata(found)
        .orderBy(
            F.col("cik").asc_nulls_last(),
            F.col("year").desc_nulls_last(),
            F.col("filename").asc_nulls_last(),
        )
        .limit(_checked(limit))
    )


def get_document(documents: DataFrame, doc_id: str) -> DataFrame:
    """Metadata of one document: one row, or none."""
    return document_metadata(documents.where(F.col("doc_id") == doc_id))


# Presets with the defaults the client methods use.


def companies_by_ticker(companies: DataFrame, ticker: str, limit: int = 50) -> DataFrame:
    return find_companies(companies, ticker=ticker, limit=limit)


def companies_by_name(companies: DataFrame, name: str, limit: int = 50) -> DataFrame:
    return find_companies(companies, name=name, limit=limit)


def company_by_cik(companies: DataFrame, cik: int) -> DataFrame:
    return find_companies(companies, cik=cik, limit=1)


def documents_by_ticker(
    tables: Tables, ticker: str, year: int | None = None, limit: int = 50
) -> DataFrame:
    return find_documents(tables, tickers=ticker, year=year, limit=limit)


def documents_by_cik(
    tables: Tables, cik: str, year: int | None = None, limit: int = 50
) -> DataFrame:
    return find_documents(tables, ciks=cik, year=year, limit=limit)


def ticker_drilldown(
    tables: Tables, ticker: str, year: int = 2019, limit: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Listings whose ticker contains the text, and documents of that exact ticker.

    An exact ticker is also contained in itself, so documents without a listing cannot occur and
    the second lookup needs no check on the first.
    """
    return (
        companies_by_ticker(tables[COMPANIES], ticker, limit),
        documents_by_ticker(tables, ticker, year, limit),
    )


def companies_with_documents(tables: Tables) -> DataFrame:
    """Listings of companies that own at least one document."""
    key = F.col("cik").cast("string")
    # One row per owner before the shuffle, however many documents it has.
    owners = tables[DOCUMENTS].select(F.col("cik").alias("owner")).distinct()
    return tables[COMPANIES].join(owners, key == F.col("owner"), "left_semi")


def company_sections(tables: Tables, cik: str) -> DataFrame:
    """A company's documents with their sections, in reading order."""
    owned = tables[DOCUMENTS].where(F.col("cik") == cik).select("doc_id", "filename", "year")
    return (
        tables[SECTIONS]
        .join(owned, "doc_id")
        .select("doc_id", "filename", "year", "section_no", "section_name", "section_text")
        .orderBy("filename", "section_no")
    )


def longest_sections(tables: Tables, limit: int = 10) -> DataFrame:
    """The longest section texts, with company and section name."""
    names = (
        tables[COMPANIES]
        .groupBy(F.col("cik").cast("string").alias("cik"))
        .agg(F.min("name").alias("company_name"))
    )
    # Cut to the longest first: labels are looked up for those rows only.
    longest = (
        tables[SECTIONS]
        .select("section_id", "doc_id", "section_name", F.length("section_text").alias("content_length"))
        .orderBy(F.col("content_length").desc_nulls_last(), "section_id")
        .limit(limit)
    )
    owners = tables[DOCUMENTS].select("doc_id", "cik")
    return (
        longest.join(owners, "doc_id", "left")
        .join(names, "cik", "left")
        .select("company_name", "section_id", "section_name", "content_length")
        .orderBy(F.col("content_length").desc_nulls_last(), "section_id")
    )


def browse(table: DataFrame, limit: int = 10) -> DataFrame:
    """A table's first rows in the order of its columns, nulls first."""
    return table.orderBy(*table.columns).limit(limit)
