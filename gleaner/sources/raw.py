"""Derive the six logical tables from the raw benchmark parquet files.

Everything up to the chunk level is row-local: a document's sections and chunks are exploded
where the document is read, and its totals are computed inside its row, so no step here shuffles
except the attachment of vectors to first chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.operators.derive import (
    chunk_rows,
    first_chunk_id,
    section_rows,
    text_totals,
)
from gleaner.schemas import (
    CHUNKS,
    COMPANIES,
    DOCUMENT_COLUMNS,
    DOCUMENTS,
    EMBEDDINGS,
    SECTIONS,
    TICKERS,
)
from gleaner.sources.tables import Tables

_BASE_YEAR = 2019
_FIRST_INGEST = "2024-01-01 00:00:00"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Give a scan of a few unsplittable files one task per core.

    A scan that already has that many tasks, as any large one does, is left alone: shuffling
    raw text would cost more than it gains.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(raw(spark, sf_dir, "documents").select("doc_id", "text"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per nation and a second one for every fifth nation."""
    nation, region = raw(spark, sf_dir, "nation"), raw(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    listings = F.array_compact(
        F.array(
            F.concat(F.lit("TK"), key),
            F.when(key % 5 == 0, F.concat(F.lit("TK"), key, F.lit("B"))),
        )
    )
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("long").alias("cik"),
        F.col("n_name").alias("name"),
        F.explode(listings).alias("ticker"),
        F.col("r_name").alias("exchange"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return raw(spark, sf_dir, "nation").select(
        key.alias("index_key"),
        key.cast("long").alias("cik"),
        F.concat(F.lit("TK"), key).alias("ticker"),
        F.col("n_name").alias("title"),
    )


def _doc_key() -> Column:
    return F.col("doc_id").cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.lit(_BASE_YEAR) - F.pmod("doc_id", F.lit(3))).cast("int")
    cik = F.expr("substr(source, 4)")
    filename = F.concat(cik, F.lit("_"), year, F.lit("_"), _doc_key(), F.lit(".json"))
    ingested = F.expr(
        f"TIMESTAMP_NTZ '{_FIRST_INGEST}' + doc_id * INTERVAL '1' MINUTE"
    )
    totals = text_totals(F.col("text"))
    return raw(spark, sf_dir, "documents").select(
        _doc_key().alias("doc_id"),
        cik.alias("cik"),
        filename.alias("filename"),
        year.alias("year"),
        F.concat(F.lit("data/"), filename).alias("file_path"),
        totals["total_sections"].alias("total_sections"),
        totals["total_chars"].alias("total_chars"),
        ingested.alias("ingested_at"),
        F.lit("v1").alias("processor_version"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_rows(_texts(spark, sf_dir).select(_doc_key().alias("doc_id"), "text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(sections(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw vector belongs to the first chunk of the document with its number."""
    first = raw(spark, sf_dir, "documents").select(
        "doc_id", first_chunk_id(_doc_key(), F.col("text")).alias("chunk_id")
    )
    vectors = raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (
        vectors.join(first.where("chunk_id IS NOT NULL"), "doc_id").select("chunk_id", "embedding")
    )


def logical_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return {
        COMPANIES: companies(spark, sf_dir),
        TICKERS: tickers(spark, sf_dir),
        DOCUMENTS: documents(spark, sf_dir).select(*DOCUMENT_COLUMNS),
        SECTIONS: sections(spark, sf_dir),
        CHUNKS: chunks(spark, sf_dir),
        EMBEDDINGS: embeddings(spark, sf_dir),
    }
