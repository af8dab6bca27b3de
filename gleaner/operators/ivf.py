"""Approximate vector search by an inverted file with compact codes, re-ranked exactly.

Vectors lie in directories by their nearest coarse centroid. A request looks into the directories of
the centroids nearest to it, reads four bits a value there, and takes the vectors that seem nearest;
of these alone whole vectors are read, and exact distances decide.

Two bounds set what is read. ``probes`` is the number of directories a request opens. Left out, it is
the number that a sample of stored vectors needed to find its own neighbours, measured when the file
is built: few where vectors form groups, and many where they do not, as no grouping then tells where
neighbours are; beyond half of the directories all are opened. ``overfetch`` is how many vectors are re-ranked for each row asked for.

The same file serves exact searches (``vector_search_bounded``): a list's centroid and its vector furthest
from that bound what the list can offer, and lists below a request's last result are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from gleaner.functions.codes import Coder, assign_lists, best_possible, exact_distances, nearest_codes
from gleaner.functions.vectors import similarity
from gleaner.operators.ranking import NAMED_HITS, label_hits, ranked, settled, top_ranked
from gleaner.operators.requests import Batch, in_batches, local_frame
from gleaner.operators.vector import HITS, exact_hits, shown_distances, unit_queries
from gleaner.plans.store import Store

MOST_LISTS = 4096
SAMPLE_VALUES = 1 << 23  # numbers in the sample that centroids are fitted on
SAMPLE_PER_LIST = 32
_SLACK = 1e-6  # angles and cosines are rounded
CALIBRATION_QUERIES = 256
CALIBRATION_NEIGHBOURS = 10
CALIBRATION_SHARE = 0.99  # of the sample's neighbours that the default number of probes finds
OVERFETCH = 4

_FOUND = "request_id string, chunk_id string, list int, key double"
_ASKED = StructType(
    [
        StructField("r", IntegerType()),
        StructField("request_id", StringType()),
        StructField("limit", IntegerType()),
        StructField("cutoff", DoubleType()),
        StructField("fetched", IntegerType()),
    ]
)
_MEASURED = "request_id string, limit int, cutoff double, chunk_id string, distance double"


@dataclass(frozen=True)
class InvertedFile:
    """Stored vectors by list, their coarse centroids, and the number of probes that was measured."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    coder: Coder
    least: np.ndarray  # cosine of a list's vectors with its centroid
    sizes: np.ndarray


def _sample(store: Store, lists: int) -> DataFrame:
    """A bounded sample of directed vectors, chosen by a hash of their id."""
    n = store.vector_count()
    rows = max(1, min(lists * SAMPLE_PER_LIST, SAMPLE_VALUES // store.dimensions()))
    drawn = F.pmod(F.xxhash64("chunk_id", F.lit("inverted file")), F.lit(max(1, n))) < F.lit(rows)
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    return store.vectors().where(F.col("norm") > 0).where(drawn).select(unit.alias("unit"))


def _needed_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """Lists, nearest first, that hold most neighbours of a sample's vectors within the sample."""
    if len(sample) < 2:
        return len(centroids)
    asked = sample[:CALIBRATION_QUERIES]
    home = np.argmax(sample @ centroids.T, axis=1)
    likeness = asked @ sample.T
    likeness[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(CALIBRATION_NEIGHBOURS, len(sample) - 1)
    near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    turns = np.take_along_axis(place, home[near], axis=1) + 1
    needed = int(np.ceil(np.quantile(turns, CALIBRATION_SHARE)))
    return needed if needed <= len(centroids) // 2 else len(centroids)


def inverted_file(store: Store, lists: int | None = None, seed: int = 7) -> InvertedFile:
    """Fit centroids on the sample, write vectors by list; both are kept with the store."""
    n, dimensions = store.vector_count(), store.dimensions()
    most = max(1, SAMPLE_VALUES // dimensions // SAMPLE_PER_LIST)
    lists = min(lists or round(n**0.5) or 1, MOST_LISTS, most)
    name = f"ivf_{lists}_{seed}"
    coder = Coder(dimensions, seed)

    def fitted() -> DataFrame:
        sample = _sample(store, lists)
        values = sample.toArrow().column("unit").combine_chunks().flatten().to_numpy().reshape(-1, dimensions)
        if len(values) == 0:
            centroids, probes = np.zeros((1, dimensions)), 1
        else:
            model = KMeans(
                featuresCol="point", k=min(lists, len(values)), distanceMeasure="cosine", maxIter=10, seed=seed
            ).fit(sample.select(array_to_vector("unit").alias("point")))
            centroids = np.array(model.clusterCenters())
            centroids /= np.maximum(np.sqrt((centroids**2).sum(axis=1)), 1e-30)[:, None]
            probes = _needed_probes(values, centroids)
        return store.spark.createDataFrame(
            [(centroids.tolist(), probes)], "centroids array<array<double>>, probes int"
        )

    fact = store.fact(f"{name}_centroids", fitted)
    centroids = np.array(fact["centroids"])

    def placed() -> DataFrame:
        vectors = store.vectors().where(F.col("norm") > 0)
        schema = vectors.schema.simpleString().removeprefix("struct<").removesuffix(">")
        return vectors.mapInArrow(
            assign_lists(centroids, coder), f"{schema}, list int, cosine double, code binary, factor float".replace(":", " ")
        )

    rows = store.inverted_lists(name, placed)

    def reaches() -> DataFrame:
        held = rows.groupBy("list").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"))
        return held.agg(F.collect_list(F.struct("list", "least", "n")).alias("lists"))  # one entry per list

    least, sizes = np.ones(len(centroids)), np.zeros(len(centroids), np.int64)
    for entry in store.fact(f"{name}_reaches", reaches)["lists"]:
        least[entry["list"]], sizes[entry["list"]] = entry["least"], entry["n"]
    return InvertedFile(rows, centroids, fact["probes"], coder, least, sizes)


def ivf_hits(
    batch: Batch,
    store: Store,
    probes: int | None = None,
    overfetch: int = OVERFETCH,
    lists: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Ranked ``(request_id, chunk_id, distance, vector_score, rank)`` among what seemed nearest."""
    batch = batch.where(lambda row: row["query_vec"] is not None)
    if not batch.rows or not store.has_vectors:
        return batch.empty(HITS)
    spark = batch.frame.sparkSession
    queries = unit_queries(batch, store.dimensions())
    stored = inverted_file(store, lists, seed)
    candidates = ivf_candidates(batch, stored, queries, probes, overfetch, store.vector_tasks())
    vectors = stored.rows
    if overfetch * sum(row["limit"] for row in batch.rows) <= NAMED_HITS:
        # few enough to be named: the scan opens their directories and reads the pages that hold them
        rows = candidates.collect()
        candidates = local_frame(spark, (row.asDict() for row in rows), candidates.schema)
        vectors = vectors.where(F.col("list").isin(sorted({row["list"] for row in rows})))
        vectors = vectors.where(F.col("chunk_id").isin(sorted({row["chunk_id"] for row in rows})))
    measured = (
        vectors.select("list", "chunk_id", "embedding", "norm")
        .join(F.broadcast(candidates), ["list", "chunk_id"])
        .select("r", "request_id", "limit", "cutoff", "chunk_id", "embedding", "norm")
        .mapInArrow(exact_distances(queries), _MEASURED)
        .where(F.col("cutoff").isNull() | (F.col("distance") <= F.col("cutoff")))
    )
    return (
        top_ranked(measured, settled(F.col("distance")), F.col("chunk_id"), limit=F.col("limit"))
        .withColumn("vector_score", similarity(F.col("distance")))
        .select("request_id", "chunk_id", "distance", "vector_score", "rank")
    )


def ivf_candidates(
    batch: Batch, stored: InvertedFile, queries: np.ndarray, probes: int | None, overfetch: int, tasks: int = 0
) -> DataFrame:
    """The rows to re-rank: at most ``overfetch`` times a request's limit, of the lists it probes."""
    count = min(probes or stored.probes, len(stored.centroids))
    # a query without direction looks nowhere
    with np.errstate(invalid="ignore"):
        order = np.argsort(-np.nan_to_num(queries @ stored.centroids.T, nan=-2.0), axis=1)[:, :count]
    looks = np.zeros((len(queries), len(stored.centroids)), bool)
    np.put_along_axis(looks, order, True, axis=1)
    ids, limits, _, allowed = batch.columns([None] * len(batch.rows))
    search = nearest_codes(ids, [overfetch * n for n in limits], allowed, queries, looks, stored.coder)
    rows = stored.rows.where(F.col("list").isin(np.flatnonzero(looks.any(axis=0)).tolist()))
    ciks = batch.filtered_ciks
    if ciks is not None:
        rows = rows.where(F.col("cik").isin(ciks))
    asked = local_frame(
        batch.frame.sparkSession,
        (
            {
                "r": n,
                "request_id": row["request_id"],
                "limit": row["limit"],
                # a maximum of 0 means none was asked for
                "cutoff": row["max_distance"] or None,
                "fetched": overfetch * row["limit"],
            }
            for n, row in enumerate(batch.rows)
        ),
        _ASKED,
    )
    found = rows.select("chunk_id", "cik", "list", "code", "factor").mapInArrow(search, _FOUND)
    best = ranked(
        found.join(F.broadcast(asked), "request_id"),
        F.col("key"),
        F.col("chunk_id"),
        limit=F.col("fetched"),
        most=overfetch * max(limits),
        tasks=tasks,
    )
    return best.select("r", "request_id", "limit", "cutoff", "chunk_id", "list")


def bounded_lists(batch: Batch, store: Store, stored: InvertedFile, queries: np.ndarray) -> list[int]:
    """The lists that may hold an exact result of some request.

    The lists that promise most are searched first, as many as hold the rows asked for. What a request
    has found by then, all its results reach; a list whose best possible cosine stays below has none.
    """
    bounds = best_possible(np.nan_to_num(queries), stored.centroids, stored.least)
    bounds[np.isnan(queries).any(axis=1)] = -np.inf
    bounds[:, stored.sizes == 0] = -np.inf
    order = np.argsort(-bounds, axis=1)
    held = np.cumsum(stored.sizes[order], axis=1)
    limits = np.array([row["limit"] for row in batch.rows])
    count = np.minimum((held < limits[:, None]).sum(axis=1) + 1, order.shape[1])
    first = sorted({int(n) for line, c in zip(order, count) for n in line[:c]})
    found = exact_hits(batch, store, stored.rows.where(F.col("list").isin(first)), queries)
    last = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("distance"))
    reached = {row["request_id"]: (row["n"], 1.0 - row["distance"]) for row in last.collect()}
    needed = np.full(len(batch.rows), -1.0)
    for n, row in enumerate(batch.rows):
        hits, cosine = reached.get(row["request_id"], (0, -1.0))
        if hits >= row["limit"]:
            needed[n] = cosine
        if row["max_distance"]:
            needed[n] = max(needed[n], 1.0 - row["max_distance"])
    return np.flatnonzero((bounds >= needed[:, None] - _SLACK).any(axis=0)).tolist()


def bounded_vector_hits(batch: Batch, store: Store, lists: int | None = None, seed: int = 7) -> DataFrame:
    """The rows of ``vector_hits``, from the lists of the inverted file that can hold them."""
    batch = batch.where(lambda row: row["query_vec"] is not None)
    if not batch.rows or not store.has_vectors:
        return batch.empty(HITS)
    queries = unit_queries(batch, store.dimensions())
    stored = inverted_file(store, lists, seed)
    chosen = bounded_lists(batch, store, stored, queries)
    return exact_hits(batch, store, stored.rows.where(F.col("list").isin(chosen)), queries)


def vector_search_bounded(
    requests: DataFrame, store: Store, lists: int | None = None, seed: int = 7
) -> DataFrame:
    """Exact nearest chunks for a request table, lists that cannot hold them left unread."""

    def search(batch: Batch) -> DataFrame:
        hits = bounded_vector_hits(batch, store, lists, seed)
        return label_hits(shown_distances(hits, batch), store, "vector", batch=batch)

    return in_batches(requests, store.companies, search)


def vector_search_ivf(
    requests: DataFrame,
    store: Store,
    probes: int | None = None,
    overfetch: int = OVERFETCH,
    lists: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Approximate nearest chunks for a request table; see ``RESULT_COLUMNS``."""

    def search(batch: Batch) -> DataFrame:
        hits = ivf_hits(batch, store, probes, overfetch, lists, seed)
        return label_hits(shown_distances(hits, batch), store, "vector", batch=batch)

    return in_batches(requests, store.companies, search, shared_pass=True)
