"""Annual-report filings as JSON objects, one per file named ``<cik>_<year>.json``.

An object maps field names to text; the fields ``section_<item>`` hold the report's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.schemas import DOCUMENTS, SECTIONS

_PREFIX = "section_"
NAME_PATTERN = r"(\d+)_(\d{4})\.json$"

# Item titles of the annual report form.
ITEM_TITLES = {
    "1": "Business",
    "1A": "Risk Factors",
    "1B": "Unresolved Staff Comments",
    "2": "Properties",
    "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity",
    "6": "Selected Financial Data",
    "7": "MD&A",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements",
    "9": "Changes in and Disagreements with Accountants",
    "9A": "Controls and Procedures",
    "9B": "Other Information",
    "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation",
    "12": "Security Ownership",
    "13": "Certain Relationships and Related Transactions",
    "14": "Principal Accountant Fees and Services",
    "15": "Exhibits and Financial Statement Schedules",
}


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``filename, file_path, cik, year, fields``."""
    files = spark.read.text(path, wholetext=True)
    return _with_keys(
        files.select(
            F.col("_metadata.file_name").alias("filename"),
            F.col("_metadata.file_path").alias("file_path"),
            _fields(),
        )
    )


def read_filing_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, whose field ``filename`` names the original file."""
    lines = spark.read.text(path).select(_fields())
    name = F.element_at("fields", F.lit("filename"))
    return _with_keys(lines.select(name.alias("filename"), name.alias("file_path"), "fields"))


def _fields() -> Column:
    return F.from_json("value", "map<string, string>", {"mode": "FAILFAST"}).alias("fields")


def _with_keys(filings: DataFrame) -> DataFrame:
    return filings.select(
        F.regexp_extract("filename", NAME_PATTERN, 1).alias("cik"),
        F.regexp_extract("filename", NAME_PATTERN, 2).cast("int").alias("year"),
        "filename",
        "file_path",
        "fields",
    )


def _doc_id() -> Column:
    return F.concat_ws("_", "cik", "year")


def _items() -> Column:
    """Non-blank items in form order, as ``(number, letter, item, text)``."""
    found = F.transform(
        F.filter(
            F.map_entries("fields"),
            lambda e: e["key"].startswith(_PREFIX) & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""),
        ),
        lambda e: _item(F.upper(F.substr(e["key"], F.lit(len(_PREFIX) + 1))), e["value"]),
    )
    return F.array_sort(found)


def _item(item: Column, text: Column) -> Column:
    return F.struct(
        F.regexp_extract(item, r"^(\d+)", 1).try_cast("int").alias("number"),
        F.regexp_extract(item, r"([A-Z]*)$", 1).alias("letter"),
        item.alias("item"),
        text.alias("text"),
    )


def filing_sections(filings: DataFrame) -> DataFrame:
    """Sections of the filings, numbered in form order; an unknown item keeps its label as name."""
    titles = F.create_map(*[F.lit(x) for pair in ITEM_TITLES.items() for x in pair])
    item = F.col("item.item")
    return filings.select(_doc_id().alias("doc_id"), F.posexplode(_items()).alias("pos", "item")).select(
        F.concat_ws("_", "doc_id", F.col("pos") + 1).alias("section_id"),
        "doc_id",
        (F.col("pos") + 1).alias("section_no"),
        F.coalesce(F.try_element_at(titles, item), item).alias("section_name"),
        F.col("item.text").alias("section_text"),
    )


def filing_documents(filings: DataFrame, processor_version: str = "v1") -> DataFrame:
    """Document metadata of the filings, totals counted inside the row."""
    texts = F.transform(_items(), lambda e: e["text"])
    return filings.select(
        _doc_id().alias("doc_id"),
        "cik",
        "filename",
        "year",
        "file_path",
        F.size(texts).cast("long").alias("total_sections"),
        F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("total_chars"),
        F.localtimestamp().alias("ingested_at"),
        F.lit(processor_version).alias("processor_version"),
    )


def filing_tables(filings: DataFrame) -> dict[str, DataFrame]:
    return {DOCUMENTS: filing_documents(filings), SECTIONS: filing_sections(filings)}
