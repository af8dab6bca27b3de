"""Table schemas, request defaults and bounds."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in fields])


COMPANIES = "company_tickers_exchange"
TICKERS = "company_tickers"
DOCUMENTS = "documents"
SECTIONS = "sections"
CHUNKS = "chunks"
EMBEDDINGS = "embeddings"

TABLE_SCHEMAS: dict[str, StructType] = {
    COMPANIES: _struct(
        ("cik", LongType()),
        ("name", StringType()),
        ("ticker", StringType()),
        ("exchange", StringType()),
    ),
    TICKERS: _struct(
        ("index_key", IntegerType()),
        ("cik", LongType()),
        ("ticker", StringType()),
        ("title", StringType()),
    ),
    # documents.cik is text while the company tables keep a number: always cast the number to
    # text when the two meet, since under ANSI mode the other direction fails on odd input.
    DOCUMENTS: _struct(
        ("doc_id", StringType()),
        ("cik", StringType()),
        ("filename", StringType()),
        ("year", IntegerType()),
        ("file_path", StringType()),
        ("total_sections", LongType()),
        ("total_chars", LongType()),
        ("ingested_at", TimestampNTZType()),
        ("processor_version", StringType()),
    ),
    SECTIONS: _struct(
        ("section_id", StringType()),
        ("doc_id", StringType()),
        ("section_no", IntegerType()),
        ("section_name", StringType()),
        ("section_text", StringType()),
    ),
    CHUNKS: _struct(
        ("chunk_id", StringType()),
        ("section_id", StringType()),
        ("doc_id", StringType()),
        ("chunk_text", StringType()),
        ("char_count", IntegerType()),
    ),
    EMBEDDINGS: _struct(
        ("chunk_id", StringType()),
        ("embedding", ArrayType(FloatType())),
    ),
}
EXPECTED_TABLES = tuple(TABLE_SCHEMAS)

DOCUMENT_COLUMNS = tuple(TABLE_SCHEMAS[DOCUMENTS].fieldNames())

REQUEST_SCHEMA = _struct(
    ("request_id", StringType()),
    ("query", StringType()),
    ("limit", IntegerType()),
    ("tickers", ArrayType(StringType())),
    ("ciks", ArrayType(StringType())),
    ("min_score", DoubleType()),
    ("include_distances", BooleanType()),
    ("max_distance", DoubleType()),
    ("fts_weight", DoubleType()),
    ("semantic_weight", DoubleType()),
    ("normalize_scores", BooleanType()),
    ("query_vec", ArrayType(FloatType())),
)

# Fixed values of the request contract.
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
DEFAULT_LOOKUP_LIMIT = 50
MAX_LOOKUP_LIMIT = 1000
DEFAULT_FTS_WEIGHT = 0.3
DEFAULT_SEMANTIC_WEIGHT = 0.7
MAX_DISTANCE = 2.0
OVERFETCH = 3

RESULT_COLUMNS = (
    "request_id",
    "rank",
    "method",
    "chunk_id",
    "doc_id",
    "cik",
    "company_name",
    "filename",
    "section_name",
    "chunk_text",
    "char_count",
    "fts_score",
    "vector_score",
    "distance",
    "combined_score",
)
