"""Approximate vector search by random-projection hashing, re-ranked exactly."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.vectors import dot, similarity
from gleaner.operators.ranking import label_hits, settled, top_ranked
from gleaner.operators.requests import Batch, in_batches, passes_filter
from gleaner.operators.vector import HITS, shown_distances, unit_queries
from gleaner.plans.store import Store


class Projections:
    """The hash functions: random projections cut into buckets, the same for rows and requests.

    On unit vectors squared Euclidean distance is twice the cosine distance, so Euclidean buckets
    serve. Wider buckets and more tables raise recall and cost.
    """

    def __init__(self, store: Store, bucket_length: float, tables: int, seed: int):
        self.tables = tables
        self.name = f"{bucket_length}_{tables}_{seed}"
        # Fitting draws the projections from the seed; it looks at the vector length only.
        sample = store.spark.createDataFrame([(Vectors.dense([0.0] * store.dimensions()),)], ["point"])
        self.model = BucketedRandomProjectionLSH(
            inputCol="point",
            outputCol="hashes",
            bucketLength=bucket_length,
            numHashTables=tables,
            seed=seed,
        ).fit(sample)

    def add_buckets(self, frame: DataFrame, unit: Column) -> DataFrame:
        """Add ``buckets``, one bucket number per hash table."""
        buckets = F.array(
            *[F.get(vector_to_array(F.get("hashes", F.lit(n))), F.lit(0)) for n in range(self.tables)]
        )
        hashed = self.model.transform(frame.withColumn("point", array_to_vector(unit)))
        return hashed.withColumn("buckets", buckets).drop("point", "hashes")


def _unit() -> Column:
    return F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))


def lsh_hits(
    batch: Batch,
    store: Store,
    bucket_length: float = 1.0,
    tables: int = 8,
    seed: int = 7,
) -> DataFrame:
    """Ranked ``(request_id, chunk_id, distance, vector_score, rank)`` among shared-bucket vectors.

    The buckets of the bounded batch are known before the scan, which opens their directories
    only. A vector meets a request once, through the first table in which both share a bucket,
    so nothing has to be made distinct and a crowded bucket is neither shuffled nor collected.
    """
    batch = batch.where(lambda row: row["query_vec"] is not None)
    if not batch.rows or not store.has_vectors:
        return batch.empty(HITS)
    queries = unit_queries(batch, store.dimensions())
    projections = Projections(store, bucket_length, tables, seed)
    stored = store.hashes(
        projections.name, lambda vectors: projections.add_buckets(vectors, _unit()), tables
    )
    spark = batch.frame.sparkSession
    columns = (
        "request_id string, limit int, cutoff double, allowed_ciks array<string>, query array<double>"
    )
    given = [
        (r["request_id"], r["limit"], r["max_distance"] or None, r["allowed_ciks"], query.tolist())
        for r, query in zip(batch.rows, queries)
    ]
    hashed = projections.add_buckets(spark.createDataFrame(given, columns), F.col("query"))
    # One row per request and table, of a bounded batch.
    rows = (
        hashed.withColumnRenamed("buckets", "query_buckets")
        .select("*", F.posexplode("query_buckets").alias("table", "bucket"))
        .withColumn("slot", store.slot_of(tables))
        .collect()
    )
    asked = spark.createDataFrame(
        rows, columns + ", query_buckets array<double>, table int, bucket double, slot int"
    )
    shared = F.zip_with("buckets", "query_buckets", lambda a, b: a == b)
    first_meeting = F.array_position(shared, F.lit(True)) == F.col("table") + 1
    similar = F.try_divide(dot(F.col("embedding"), F.col("query")), F.col("norm"))
    candidates = (
        stored.where(F.col("slot").isin(sorted({row["slot"] for row in rows})))
        .join(F.broadcast(asked), ["slot", "table", "bucket"])
        .where(first_meeting & passes_filter(F.col("allowed_ciks"), F.col("cik")))
        .withColumn("distance", F.lit(1.0) - similar)
        .where(F.col("cutoff").isNull() | (F.col("distance") <= F.col("cutoff")))
        .select("request_id", "chunk_id", "distance", "limit")
    )
    return (
        top_ranked(candidates, settled(F.col("distance")), F.col("chunk_id"), limit=F.col("limit"))
        .withColumn("vector_score", similarity(F.col("distance")))
        .select("request_id", "chunk_id", "distance", "vector_score", "rank")
    )


def vector_search_lsh(
    requests: DataFrame,
    store: Store,
    bucket_length: float = 1.0,
    tables: int = 8,
    seed: int = 7,
) -> DataFrame:
    """Approximate nearest chunks for a request table; see ``RESULT_COLUMNS``."""

    def search(batch: Batch) -> DataFrame:
        hits = lsh_hits(batch, store, bucket_length, tables, seed)
        return label_hits(shown_distances(hits, batch), store, "vector", batch=batch)

    return in_batches(requests, store.companies, search)
