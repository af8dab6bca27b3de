"""What a result table consists of: composition, explanations, envelopes, views for readers.

Every group here is one request's hits, at most 100 rows by the request contract.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.text import excerpt
from gleaner.operators.bm25 import Bm25
from gleaner.operators.hybrid import branches, fuse, fused_hits, hybrid_hits, normalized_weights
from gleaner.operators.ranking import label_hits
from gleaner.operators.requests import Batch, in_batches
from gleaner.plans.store import Analyzer, Store
from gleaner.schemas import RESULT_COLUMNS

# The texts of an explanation's steps.
STEP_TEXTS = (
    "Performed FTS search for exact keyword matching",
    "Performed vector search for semantic similarity",
    "Combined results with weighted scoring",
    "Returned top {} results",
)
_COUNTS = ("fts_results", "vector_results", "combined_unique")


def _score(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def company_key() -> Column:
    return F.coalesce(F.nullif("company_name", F.lit("")), F.col("cik"))


def company_distribution(results: DataFrame) -> DataFrame:
    """Hits per request and company, most first."""
    return (
        results.groupBy("request_id", company_key().alias("company"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy("request_id", F.desc("hits"), "company")
    )


def composition(
    results: DataFrame, requests: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per request: which search found its hits, which companies, and the range of scores.

    A request without hits has a total of 0 and nulls. Sums are taken per company first, so both
    levels combine before they are shuffled. ``keep`` names columns equal on all of a request's
    hits, to carry along.
    """
    by_text, by_vector = _score("fts_score") > 0, _score("vector_score") > 0
    no_text, no_vector = _score("fts_score") == 0, _score("vector_score") == 0
    per_company = results.groupBy("request_id", company_key().alias("company")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(by_text & no_vector).alias("fts_only"),
        F.count_if(no_text & by_vector).alias("vector_only"),
        F.count_if(by_text & by_vector).alias("both_methods"),
        F.sum(_score("combined_score")).alias("total"),
        F.min(_score("combined_score")).alias("least"),
        F.max(_score("combined_score")).alias("most"),
        *[F.max(c).alias(c) for c in keep],
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "company"))),
        lambda e: F.struct(e["company"].alias("company"), (-e["minus"]).alias("hits")),
    )
    summed = per_company.groupBy("request_id").agg(
        F.sum("n").alias("total_results"),
        F.sum("fts_only").alias("fts_only"),
        F.sum("vector_only").alias("vector_only"),
        F.sum("both_methods").alias("both_methods"),
        (F.sum("total") / F.sum("n")).alias("combined_score_avg"),
        F.min("least").alias("combined_score_min"),
        F.max("most").alias("combined_score_max"),
        ordered.alias("company_distribution"),
        *[F.max(c).alias(c) for c in keep],
    )
    return (
        requests.select("request_id")
        .join(summed, "request_id", "left")
        .withColumn("total_results", F.coalesce("total_results", F.lit(0).cast("long")))
    )


def distribution_map(distribution: Column) -> Column:
    """The company list of a composition as an insertion-ordered map."""
    return F.map_from_entries(distribution)


def distribution_text(distribution: Column) -> Column:
    return F.array_join(
        F.transform(distribution, lambda e: F.concat(e["company"], F.lit("="), e["hits"])), "; "
    )


def search_summary(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: hits returned, hits by method, average scores (null without hits)."""
    by_text, by_vector = _score("fts_score") > 0, _score("vector_score") > 0
    counted = results.groupBy("request_id").agg(
        F.first("method").alias("method"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(by_text).alias("fts_count"),
        F.count_if(by_vector).alias("vector_count"),
        F.count_if(by_text & by_vector).alias("both"),
        F.avg(_score("vector_score")).alias("avg_similarity"),
        F.avg(_score("combined_score")).alias("avg_combined_score"),
    )

    def count(value: Column) -> Column:
        return F.coalesce(value, F.lit(0).cast("long"))

    return requests.select("request_id", F.col("query").alias("test_query")).join(
        counted, "request_id", "left"
    ).select(
        "request_id",
        "test_query",
        "method",
        count(F.col("n")).alias("results_found"),
        count(F.col("fts_count") - F.col("both")).alias("fts_only"),
        count(F.col("vector_count") - F.col("both")).alias("vector_only"),
        count(F.col("both")).alias("both_methods"),
        "avg_similarity",
        "avg_combined_score",
    )


def explain_hybrid(
    requests: DataFrame,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """One row per hybrid request: weights, candidate counts, steps and composition."""

    def explain(batch: Batch) -> DataFrame:
        return _explained(_counted_results(batch, store, analyzer, model), batch)

    return in_batches(requests, store.companies, explain, hybrid=True)


def _counted_results(batch: Batch, store: Store, analyzer: Analyzer, model: Bm25) -> DataFrame:
    """Labelled hybrid hits with the candidate counts of their request."""
    hits = hybrid_hits(batch, store, analyzer, model)
    return label_hits(hits, store, "hybrid", keep=_COUNTS, batch=batch)


def _explained(results: DataFrame, batch: Batch) -> DataFrame:
    return (
        composition(results, batch.frame, keep=_COUNTS)
        .join(F.broadcast(normalized_weights(batch.frame)), "request_id")
        .join(
            F.broadcast(batch.frame.select("request_id", "query", "fts_weight", "semantic_weight")),
            "request_id",
        )
        .select(
            "request_id",
            F.col("query").alias("original_query"),
            F.lit("hybrid").alias("search_method"),
            "fts_weight",
            "semantic_weight",
            F.col("normalize_scores").alias("normalized"),
            F.col("fts_share").alias("normalized_fts_weight"),
            F.col("vector_share").alias("normalized_semantic_weight"),
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS],
            *_steps(F.col("total_results")),
            F.col("total_results").alias("results_found"),
            "fts_only",
            "vector_only",
            "both_methods",
            "company_distribution",
            "combined_score_avg",
            "combined_score_min",
            "combined_score_max",
        )
    )


def explained_envelope(
    requests: DataFrame,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """The response of a hybrid search with its explanation in it: one row per request.

    The search is run once; its labelled hits are kept and read for both parts.
    """

    def respond(batch: Batch) -> DataFrame:
        results = written_hits(store, _counted_results(batch, store, analyzer, model))
        explained = _explained(results, batch)
        fields = [c for c in explained.columns if c != "request_id"]
        explained = explained.select("request_id", F.struct(*fields).alias("explanation"))
        return envelope(results, batch.frame, "hybrid").join(explained, "request_id", "left")

    return in_batches(requests, store.companies, respond, hybrid=True)


def _steps(returned: Column) -> list[Column]:
    *fixed, last = STEP_TEXTS
    before, after = last.split("{}")
    steps = [F.lit(text) for text in fixed]
    steps.append(F.concat(F.lit(before), returned, F.lit(after)))
    return [step.alias(f"step_{n}") for n, step in enumerate(steps, 1)]


def envelope(results: DataFrame, requests: DataFrame, method: str) -> DataFrame:
    """One row per request with its hits as a nested list in rank order."""
    item = F.struct("rank", *[c for c in RESULT_COLUMNS if c not in ("request_id", "rank", "method")])
    nested = results.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    empty = F.array().cast(nested.schema["results"].dataType)
    joined = requests.select("request_id", "query").join(nested, "request_id", "left")
    return joined.withColumn("results", F.coalesce("results", empty)).select(
        "request_id",
        "query",
        F.lit(method).alias("method"),
        F.size("results").cast("long").alias("total_results"),
        "results",
    )


def written_hits(store: Store, hits: DataFrame) -> DataFrame:
    """Ranked hits, bounded by their batch, kept in the shared folder to be read more than once."""
    path = f"{store.path}/hits/{uuid.uuid4().hex}"
    hits.write.parquet(path)
    return store.spark.read.schema(hits.schema).parquet(path)


def compare_methods(
    requests: DataFrame,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """Keyword, vector and hybrid hits of each request side by side.

    ``found_by`` counts the methods that returned the same chunk for the same request.
    """
    scores = ("fts_score", "vector_score", "distance", "combined_score")

    def tagged(hits: DataFrame, method: str) -> DataFrame:
        columns = [
            F.col(c) if c in hits.columns else F.lit(None).cast("double").alias(c) for c in scores
        ]
        return hits.select("request_id", "chunk_id", "rank", F.lit(method).alias("method"), *columns)

    def search(batch: Batch) -> DataFrame:
        # Each branch runs once, at the wider limit and without thresholds; a single search's hits
        # are its first rows within the threshold, a fusion's those of requests that weigh it.
        request_chunk = Window.partitionBy("request_id", "chunk_id")
        fts, vector = (written_hits(store, hits) for hits in branches(batch, store, analyzer, model, every=True))
        asked = F.broadcast(
            batch.frame.select("request_id", "limit", "min_score", "max_distance", "fts_weight", "semantic_weight")
        )

        def single(hits: DataFrame, enough: Column) -> DataFrame:
            kept = hits.join(asked, "request_id").where(F.coalesce(enough, F.lit(True)))
            return kept.where(F.col("rank") <= F.col("limit"))

        def weighed(hits: DataFrame, weight: str) -> DataFrame:
            return hits.join(asked.where(F.col(weight) > 0).select("request_id"), "request_id", "left_semi")

        fused = fuse(
            weighed(fts, "fts_weight"), weighed(vector, "semantic_weight"), normalized_weights(batch.frame)
        )
        hits = reduce(
            DataFrame.unionByName,
            [
                tagged(single(fts, F.nullif("min_score", F.lit(0.0)) <= F.col("fts_score")), "fts"),
                tagged(single(vector, F.nullif("max_distance", F.lit(0.0)) >= F.col("distance")), "vector"),
                tagged(fused_hits(fused, batch), "hybrid"),
            ],
        )
        counted = hits.withColumn("found_by", F.count(F.lit(1)).over(request_chunk))
        return label_hits(counted, store, keep=("found_by",), batch=batch, methods=3)

    return in_batches(requests, store.companies, search, hybrid=True)


def result_cards(results: DataFrame) -> DataFrame:
    """Hits as a reader sees them: company label, text excerpt, scores to three decimals."""
    return results.select(
        "request_id",
        "rank",
        F.coalesce("company_name", F.lit("Unknown Company")).alias("company"),
        "section_name",
        "filename",
        excerpt(F.col("chunk_text")).alias("excerpt"),
        *[
            F.round(c, 3).alias(c)
            for c in ("fts_score", "vector_score", "distance", "combined_score")
        ],
    )


def legacy_results(results: DataFrame, documents: DataFrame) -> DataFrame:
    """The older flat result form; its score is the first one that is present and not 0."""

    def truthy(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(0.0))

    last = F.coalesce(truthy("combined_score"), truthy("fts_score"), F.col("vector_score"))
    # Hits come from known documents, so the inner join keeps all and may broadcast either side.
    return results.join(documents.select("doc_id", "year"), "doc_id").select(
        "request_id",
        "rank",
        "doc_id",
        "cik",
        "filename",
        "year",
        F.coalesce(F.nullif("company_name", F.lit("")), F.lit("Unknown")).alias("company_name"),
        "section_name",
        F.col("chunk_text").alias("content_snippet"),
        "char_count",
        last.alias("search_score"),
    )
