"""Lookups for a whole table of requests.

Company requests have patterns, which no equality joins. Each one is therefore looked up by one key
that every match has: its cik, a piece of up to three characters of a pattern, its exchange; of several
it takes the one that the fewest listings have. Listings are unfolded into such keys, those that
somebody asks for, and what meets is verified by all filters. Equal requests are answered once.

Requests without a filter, or with a limit out of bounds, are handed back with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.schemas import COMPANIES, DEFAULT_LOOKUP_LIMIT, DOCUMENTS, MAX_LOOKUP_LIMIT
from gleaner.operators.lookup import document_metadata
from gleaner.sources.tables import Tables

COMPANY_REQUESTS = "request_id string, name string, ticker string, cik long, exchange string, limit int"
DOCUMENT_REQUESTS = "request_id string, tickers array<string>, ciks array<string>, year int, limit int"

_WIDTH = 3  # characters of a key's piece
_ESCAPE = "\x01"
_FILTERS = ("name", "ticker", "cik", "exchange")


def _split(requests: DataFrame, given: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Requests that can be answered, and the others with a ``reason``."""
    limit = F.coalesce("limit", F.lit(DEFAULT_LOOKUP_LIMIT))
    nothing = ~F.coalesce(*[F.when(g, F.lit(True)) for g in given], F.lit(False))
    reason = F.concat_ws(
        "; ",
        F.when(F.col("request_id").isNull(), F.lit("no request id")),
        F.when(nothing, F.lit("no filter")),
        F.when((limit < 1) | (limit > MAX_LOOKUP_LIMIT), F.lit("limit out of bounds")),
    )
    judged = requests.withColumn("limit", limit).withColumn("reason", reason)
    return judged.where("reason = ''").drop("reason"), judged.where("reason <> ''")


def _runs(text: Column, width: Column) -> Column:
    """All runs of so many characters of a text that has at least as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substr(text, i, width))


def _pieces(text: Column) -> Column:
    """All runs of up to ``_WIDTH`` characters."""
    nothing = F.array().cast("array<string>")
    widths = [F.lit(width) for width in range(1, _WIDTH + 1)]
    return F.flatten(F.array(*[F.when(F.length(text) >= w, _runs(text, w)).otherwise(nothing) for w in widths]))


def _pattern_pieces(pattern: Column) -> Column:
    """A piece of each width that all matches of a pattern hold: whole runs between wildcards, or parts of them."""
    runs = F.filter(F.split(F.lower(pattern), "[%_]"), lambda run: run != "")
    return F.flatten(F.transform(runs, lambda run: _runs(run, F.least(F.length(run), F.lit(_WIDTH)))))


def _tagged(tag: str, values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda v: F.concat(F.lit(f"{tag}:"), v)), F.array().cast("array<string>"))


def _one(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.concat(F.lit(f"{tag}:"), value.cast("string")))).otherwise(
        F.array().cast("array<string>")
    )


def _listing_keys(companies: DataFrame) -> DataFrame:
    keys = F.concat(
        F.array(F.lit("*")),
        _one("c", F.col("cik")),
        _one("e", F.upper("exchange")),
        _tagged("n", _pieces(F.lower("name"))),
        _tagged("t", _pieces(F.lower("ticker"))),
    )
    return companies.select(*_FILTERS, F.explode(F.array_distinct(keys)).alias("key"))


def _contains(text: Column, pattern: Column) -> Column:
    """Like ``contains_ci`` for a column of patterns; a pattern that is not given is met."""
    escaped = F.replace(F.lower(pattern), F.lit(_ESCAPE), F.lit(_ESCAPE * 2))
    held = F.like(F.lower(text), F.concat(F.lit("%"), escaped, F.lit("%")), F.lit(_ESCAPE))
    return pattern.isNull() | F.coalesce(held, F.lit(False))


def find_companies_batch(requests: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(request_id, rank, cik, name, ticker, exchange)`` and rejected requests.

    Rows and their order are those of ``find_companies``; draws are settled by cik and exchange.
    """
    asked = requests.select(
        "request_id",
        F.nullif("name", F.lit("")).alias("name"),
        F.nullif("ticker", F.lit("")).alias("ticker"),
        F.nullif("cik", F.lit(0)).cast("long").alias("cik"),
        F.nullif("exchange", F.lit("")).alias("exchange"),
        "limit",
    )
    valid, rejected = _split(asked, [F.col(c).isNotNull() for c in _FILTERS])
    valid = valid.withColumn("content", F.to_json(F.struct(*_FILTERS)))
    contents = valid.groupBy("content", *_FILTERS).agg(F.max("limit").alias("most"))
    options = F.concat(
        F.array(F.lit("*")),
        _one("c", F.col("cik")),
        _one("e", F.upper("exchange")),
        _tagged("n", _pattern_pieces(F.col("name"))),
        _tagged("t", _pattern_pieces(F.col("ticker"))),
    )
    options = contents.select("content", F.explode(F.array_distinct(options)).alias("key"))
    listed = _listing_keys(companies)
    counts = listed.join(options.select("key").distinct(), "key", "left_semi").groupBy("key").count()
    # the key that the fewest have; one that nobody has comes first and leads nowhere
    chosen = (
        options.join(counts, "key", "left")
        .groupBy("content")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    )
    wanted = chosen.join(contents, "content")
    wanted = wanted.select("key", "content", "most", *[F.col(c).alias(f"_{c}") for c in _FILTERS])
    matched = listed.join(wanted, "key").where(
        _contains(F.col("name"), F.col("_name"))
        & _contains(F.col("ticker"), F.col("_ticker"))
        & (F.col("_cik").isNull() | F.coalesce(F.col("cik") == F.col("_cik"), F.lit(False)))
        & (F.col("_exchange").isNull() | F.coalesce(F.upper("exchange") == F.upper("_exchange"), F.lit(False)))
    )
    order = [F.col(c).asc_nulls_last() for c in ("name", "ticker", "cik", "exchange")]
    rank = F.row_number().over(Window.partitionBy("content").orderBy(*order))
    best = matched.withColumn("rank", rank).where((F.col("rank") <= MAX_LOOKUP_LIMIT) & (F.col("rank") <= F.col("most")))
    found = best.select("content", "rank", *_FILTERS).join(valid.select("request_id", "content", "limit"), "content")
    found = found.where(F.col("rank") <= F.col("limit"))
    return found.select("request_id", "rank", "cik", "name", "ticker", "exchange"), rejected


def find_documents_batch(requests: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``(request_id, rank, …metadata)`` and rejected requests; rows and order as ``find_documents``.

    Tickers become ciks by a join; a request that names ciks or tickers meets documents by cik, one
    that names a year only by year. Tickers that lead nowhere match nothing.
    """

    def listed(column: str) -> Column:
        return F.array_distinct(F.filter(F.transform(column, lambda v: F.trim(v)), lambda v: v != ""))

    asked = requests.select(
        "request_id",
        F.transform(listed("tickers"), lambda v: F.upper(v)).alias("tickers"),
        listed("ciks").alias("ciks"),
        F.nullif("year", F.lit(0)).alias("year"),
        "limit",
    )
    named = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("tickers", "ciks")}
    valid, rejected = _split(asked, [*named.values(), F.col("year").isNotNull()])
    directory = tables[COMPANIES].select(F.upper("ticker").alias("ticker"), F.col("cik").cast("string").alias("cik")).distinct()
    by_ticker = (
        valid.where(named["tickers"])
        .select("request_id", "ciks", "year", "limit", F.explode("tickers").alias("ticker"))
        .join(directory, "ticker")
        .where(~named["ciks"] | F.array_contains("ciks", F.col("cik")))
        .select("request_id", "cik", "year", "limit")
        .distinct()
    )
    by_cik = valid.where(named["ciks"] & ~named["tickers"])
    by_cik = by_cik.select("request_id", F.explode("ciks").alias("cik"), "year", "limit")
    by_year = valid.where(~named["ciks"] & ~named["tickers"]).select("request_id", "year", "limit")
    documents = document_metadata(tables[DOCUMENTS])
    columns = ("request_id", "limit", *documents.columns)
    wanted = by_ticker.unionByName(by_cik).withColumnRenamed("year", "_year")
    of_ciks = documents.join(wanted, "cik").where(F.col("_year").isNull() | (F.col("year") == F.col("_year")))
    matched = of_ciks.select(*columns).unionByName(documents.join(by_year, "year").select(*columns))
    order = (F.col("cik").asc_nulls_last(), F.col("year").desc_nulls_last(), F.col("filename").asc_nulls_last(), "doc_id")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    best = matched.withColumn("rank", rank).where((F.col("rank") <= MAX_LOOKUP_LIMIT) & (F.col("rank") <= F.col("limit")))
    return best.select("request_id", "rank", *documents.columns), rejected
