"""Weighted fusion of keyword and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.bm25 import Bm25, bm25_hits
from gleaner.operators.ranking import label_hits, settled, top_ranked
from gleaner.operators.requests import Batch, in_batches
from gleaner.operators.vector import vector_hits
from gleaner.plans.store import Analyzer, Store
from gleaner.schemas import MAX_LIMIT, OVERFETCH


def normalized_weights(requests: DataFrame) -> DataFrame:
    """Both weights divided by their sum."""
    total = F.col("fts_weight") + F.col("semantic_weight")
    return requests.select(
        "request_id",
        "normalize_scores",
        (F.col("fts_weight") / total).alias("fts_share"),
        (F.col("semantic_weight") / total).alias("vector_share"),
    )


def _scaled(score: Column) -> Column:
    """Score divided by the request's best candidate; 1 stands in for a best of 0."""
    best = F.max(score).over(Window.partitionBy("request_id"))
    return score / F.when(best > 0, best).otherwise(F.lit(1.0))


def fuse(fts: DataFrame, vector: DataFrame, weights: DataFrame) -> DataFrame:
    """Merge two candidate lists of each request by chunk.

    A chunk missing from one list scores 0 there. Candidate counts are taken before any cut.
    Both lists are bounded per request, so the joins here move a few hundred rows per request.
    """
    keyword = fts.select(
        "request_id", "chunk_id", "fts_score", F.col("rank").alias("fts_rank")
    ).withColumn("fts_scaled", _scaled(F.col("fts_score")))
    semantic = vector.select(
        "request_id", "chunk_id", "vector_score", "distance", F.col("rank").alias("vector_rank")
    ).withColumn("vector_scaled", _scaled(F.col("vector_score")))

    def side(name: str) -> Column:
        chosen = F.when(F.col("normalize_scores"), F.col(f"{name}_scaled")).otherwise(
            F.col(f"{name}_score")
        )
        return F.coalesce(chosen, F.lit(0.0))

    request = Window.partitionBy("request_id")
    return (
        keyword.join(semantic, ["request_id", "chunk_id"], "full_outer")
        .join(F.broadcast(weights), "request_id")
        .select(
            "request_id",
            "chunk_id",
            side("fts").alias("fts_score"),
            side("vector").alias("vector_score"),
            "distance",
            (side("fts") * F.col("fts_share") + side("vector") * F.col("vector_share")).alias(
                "combined_score"
            ),
            "fts_rank",
            "vector_rank",
            F.count("fts_rank").over(request).alias("fts_results"),
            F.count("vector_rank").over(request).alias("vector_results"),
            F.count(F.lit(1)).over(request).alias("combined_unique"),
        )
    )


def branches(
    batch: Batch, store: Store, analyzer: Analyzer, model: Bm25, every: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Keyword and vector hits at three times the limit (100 at most), without thresholds.

    A branch only sees requests that give it weight, unless ``every`` one is asked for.
    """
    wide = batch.map(
        lambda row: {
            "limit": min(OVERFETCH * row["limit"], MAX_LIMIT),
            "min_score": None,
            "max_distance": None,
        }
    )
    return (
        bm25_hits(wide.where(lambda row: every or row["fts_weight"] > 0), store, analyzer, model),
        vector_hits(wide.where(lambda row: every or row["semantic_weight"] > 0), store),
    )


def fused_hits(candidates: DataFrame, batch: Batch) -> DataFrame:
    """Best fused chunks; on a draw keyword hits keep their order ahead of vector-only ones."""
    return top_ranked(
        candidates.join(F.broadcast(batch.frame.select("request_id", "limit")), "request_id"),
        settled(F.col("combined_score")).desc(),
        F.col("fts_rank").asc_nulls_last(),
        F.col("vector_rank"),
        F.col("chunk_id"),
        limit=F.col("limit"),
    )


def hybrid_hits(
    batch: Batch,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """Both branches, fused, and the best of them."""
    fts, vector = branches(batch, store, analyzer, model)
    return fused_hits(fuse(fts, vector, normalized_weights(batch.frame)), batch)


def hybrid_search(
    requests: DataFrame,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """Combined search for a request table; see ``RESULT_COLUMNS``."""

    def search(batch: Batch) -> DataFrame:
        return label_hits(hybrid_hits(batch, store, analyzer, model), store, "hybrid", batch=batch)

    return in_batches(requests, store.companies, search, hybrid=True, shared_pass=True)
