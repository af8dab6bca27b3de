"""Counts over the tables, and what searches they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.plans.store import vector_facts
from gleaner.schemas import (
    CHUNKS,
    DEFAULT_FTS_WEIGHT,
    DEFAULT_SEMANTIC_WEIGHT,
    EMBEDDINGS,
    EXPECTED_TABLES,
)
from gleaner.sources.tables import Tables, table_inventory


def table_counts(spark: SparkSession, tables: Tables) -> DataFrame:
    """One row with the row count of every expected table; an absent table counts 0."""
    counted = table_inventory(spark, tables)
    return counted.agg(
        *[
            F.sum(F.when(F.col("table_name") == name, F.col("row_count"))).alias(name)
            for name in EXPECTED_TABLES
        ]
    )


def capabilities(spark: SparkSession, tables: Tables, ranked: bool = True) -> DataFrame:
    """One row: possible searches, counts, vector length, text method and default weights.

    The vector length is the one the store searches with; ``ranked`` is the store's and decides the
    method, as it does for ``text_search``.
    """
    one = spark.range(1)
    if CHUNKS in tables:
        chunks = tables[CHUNKS].agg(F.count(F.lit(1)).alias("total_chunks"))
    else:
        chunks = one.select(F.lit(0).cast("long").alias("total_chunks"))
    if EMBEDDINGS in tables:
        vectors = vector_facts(tables[EMBEDDINGS]).select(
            F.col("n").alias("total_embeddings"), F.col("dimensions").cast("long").alias("vector_dimensions")
        )
    else:
        vectors = one.select(
            F.lit(0).cast("long").alias("total_embeddings"), F.lit(None).cast("long").alias("vector_dimensions")
        )
    both = chunks.withColumn("k", F.lit(1)).join(vectors.withColumn("k", F.lit(1)), "k")
    return both.select(
        (F.col("total_chunks") > 0).alias("fts_available"),
        (F.col("total_embeddings") > 0).alias("vector_available"),
        ((F.col("total_chunks") > 0) | (F.col("total_embeddings") > 0)).alias("hybrid_available"),
        F.when((F.col("total_chunks") > 0) & F.lit(ranked), F.lit("BM25")).otherwise(F.lit("LIKE")).alias("search_method"),
        "total_chunks",
        "total_embeddings",
        "vector_dimensions",
        F.lit(DEFAULT_FTS_WEIGHT).alias("default_fts_weight"),
        F.lit(DEFAULT_SEMANTIC_WEIGHT).alias("default_semantic_weight"),
    )


def is_empty(table: DataFrame) -> bool:
    return table.isEmpty()
