"""BM25 keyword search over the stored postings and term counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from gleaner.functions.blocks import CANDIDATES, TermWeights, best_keyword_scores
from gleaner.operators.ranking import label_hits, ranked, settled, top_ranked
from gleaner.operators.requests import Batch, in_batches, local_frame, passes_filter
from gleaner.plans.store import Analyzer, Store
from gleaner.schemas import MAX_LIMIT

# (request, term) pairs that are held and broadcast at once; a batch with more is cut by requests.
TERMS_AT_ONCE = 100_000
# Terms named in a scan filter. More of them read every chunk once instead: see ``bm25_hits``.
MAX_NAMED_TERMS = 5_000
# Up to this many (request, term) pairs a batch always reads postings; beyond, it does so while it
# matches at most this share of them.
FEW_TERMS = 64
DENSE_SHARE = 0.25
# Postings that a batch must match before blocks are weighed against its results: see ``_worth_reading``.
WEIGH_FROM = 20_000_000
# Blocks named in a scan filter; where more of them may hold results, all are read.
MAX_NAMED_BLOCKS = 2_000
_SLACK = 1e-6  # scores may differ by the order in which they are summed

_TERMS = StructType([StructField("r", IntegerType()), StructField("term", StringType())])
_WEIGHTS = StructType([*_TERMS, StructField("df", LongType())])
_REACH = StructType([StructField("r", IntegerType()), StructField("reach", DoubleType())])
_PARAMS = StructType(
    [
        StructField("r", IntegerType()),
        StructField("request_id", StringType()),
        StructField("limit", IntegerType()),
        StructField("min_score", DoubleType()),
        StructField("allowed_ciks", ArrayType(StringType())),
    ]
)
_HITS = "request_id string, chunk_id string, fts_score double, rank int"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, n_chunks: int, df: Column) -> Column:
        return F.log10((F.lit(float(n_chunks)) - df + 0.5) / (df + 0.5) + 1.0)

    def idf_value(self, n_chunks: int, df: int) -> float:
        return math.log10((n_chunks - df + 0.5) / (df + 0.5) + 1.0)

    @property
    def name(self) -> str:
        return f"{self.k1}_{self.b}"

    def saturation(self, tf: Column, dl: Column, avgdl: float) -> Column:
        length = F.lit(1.0 - self.b) + F.lit(self.b) * dl / F.lit(avgdl)
        return tf * F.lit(self.k1 + 1.0) / (tf + F.lit(self.k1) * length)


def query_terms(requests: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """Distinct terms of each request's query."""
    found = F.array_distinct(analyzer.terms(F.col("query")))
    return requests.select("request_id", F.explode(found).alias("term"))


def bm25_hits(
    batch: Batch,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
    weigh: bool | None = None,
) -> DataFrame:
    """Ranked ``(request_id, chunk_id, fts_score, rank)``.

    Any matching term scores. Frequencies and lengths are those of the whole corpus; company
    filters drop rows without changing the score of the others.

    A batch that matches a small part of the postings reads that part (``_from_postings``). One
    that would multiply the postings by its requests, or names too many terms for a scan filter,
    reads every chunk once instead (``_from_chunks``). Both give the same rows. Terms are held for
    at most ``TERMS_AT_ONCE`` pairs, or one request; the postings are never shuffled. A few requests
    that match very many postings read those blocks only that may hold results (``_worth_reading``),
    where the bounds of blocks have been written (``write_peaks``): that reads more than the search
    itself. ``weigh`` overrules what counts as very many, and writes the bounds where there are none.
    """
    if not batch.rows:
        return batch.empty(_HITS)
    wanted = query_terms(batch.frame, analyzer)
    found = wanted.limit(TERMS_AT_ONCE + 1).collect()
    if len(found) <= TERMS_AT_ONCE:
        return _hits_of(batch, found, store, analyzer, model, weigh)
    counts = {row["request_id"]: row["count"] for row in wanted.groupBy("request_id").count().collect()}
    parts = [
        _hits_of(part, query_terms(part.frame, analyzer).collect(), store, analyzer, model, weigh)
        for part in _cut(batch, counts)
    ]
    return reduce(DataFrame.unionByName, parts)


def _cut(batch: Batch, counts: dict[str, int]) -> Iterator[Batch]:
    """Requests in turn, as many as stay within ``TERMS_AT_ONCE`` pairs, and one at least."""
    ids: set[str] = set()
    pairs = 0
    for row in batch.rows:
        count = counts.get(row["request_id"], 0)
        if ids and pairs + count > TERMS_AT_ONCE:
            yield batch.where(lambda r, ids=frozenset(ids): r["request_id"] in ids)
            ids, pairs = set(), 0
        ids.add(row["request_id"])
        pairs += count
    yield batch.where(lambda r: r["request_id"] in ids)


def _hits_of(
    batch: Batch, found: list[Row], store: Store, analyzer: Analyzer, model: Bm25, weigh: bool | None
) -> DataFrame:
    numbers = {row["request_id"]: n for n, row in enumerate(batch.rows)}
    entries = ({"r": numbers[row["request_id"]], "term": row["term"]} for row in found)
    wanted = F.broadcast(local_frame(batch.frame.sparkSession, entries, _TERMS))
    named = sorted({row["term"] for row in found})
    few = len(named) <= MAX_NAMED_TERMS
    # Named terms reach the scans, which skip all other pages.
    terms = store.terms(analyzer).where(_among(named)) if few else store.terms(analyzer)
    weights = terms.join(wanted, "term").select("r", "term", "df")
    if weigh is None:
        least = WEIGH_FROM if store.has_peaks(model.name, analyzer) else math.inf
    else:
        least = 0 if weigh else math.inf
    if len(found) <= FEW_TERMS and store.corpus(analyzer)["n_postings"] < least:
        return _from_postings(batch, store, analyzer, model, F.broadcast(weights), named)
    rows = weights.collect()
    matched = sum(row["df"] for row in rows)
    weights = F.broadcast(local_frame(batch.frame.sparkSession, (row.asDict() for row in rows), _WEIGHTS))
    if len(found) <= FEW_TERMS:
        blocks = _worth_reading(batch, store, analyzer, model, rows, weights) if matched >= least else None
        return _from_postings(batch, store, analyzer, model, weights, named, blocks)
    if not few or matched > DENSE_SHARE * store.corpus(analyzer)["n_postings"]:
        return _from_chunks(batch, store, analyzer, model, rows)
    return _from_postings(batch, store, analyzer, model, weights, named)


def _peaks(store: Store, analyzer: Analyzer, model: Bm25) -> DataFrame:
    value = lambda length: model.saturation(F.col("tf"), F.col("dl"), length)
    return store.peaks(model.name, value, analyzer)


def write_peaks(store: Store, analyzer: Analyzer = Analyzer(), model: Bm25 = Bm25()) -> None:
    """The bounds of blocks, for a corpus that will be searched often."""
    _peaks(store, analyzer, model)


def _worth_reading(
    batch: Batch, store: Store, analyzer: Analyzer, model: Bm25, rows: list[Row], weights: DataFrame
) -> list[int] | None:
    """Blocks that may hold results of some request, or None where they are too many to be named.

    A block's bound for a request is the sum of its terms' largest parts there. For frequent terms
    these are stored; the postings of the others are few and are read for it. The blocks with the
    highest bounds are scored first, as many as results are wanted. The last result so far is a
    score that all results reach, so blocks with a lower bound hold none. Frequencies, lengths and
    ranks are as without this: the rows that are left out could not be among the results.
    """
    frequent = sorted({row["term"] for row in rows if row["df"] >= store.peak_terms_from()})
    others = sorted({row["term"] for row in rows} - set(frequent))
    corpus = store.corpus(analyzer)
    avgdl = corpus["avgdl"] or 1.0
    value = model.saturation(F.col("tf"), F.col("dl"), avgdl)
    peaks = _peaks(store, analyzer, model).where(_among(frequent)).select("term", "block", "peak")
    found = store.postings(analyzer).where(_among(others)).groupBy("term", "block").agg(F.max(value).alias("peak"))
    bounds = (
        peaks.unionByName(found)
        .join(weights, "term")
        .groupBy("r", "block")
        .agg(F.sum(model.idf(corpus["n_chunks"], F.col("df")) * F.col("peak")).alias("bound"))
    )
    limits = F.broadcast(batch_frame(batch).select("r", "limit"))
    first = ranked(
        bounds.join(limits, "r"), F.col("bound").desc(), F.col("block"), limit=F.col("limit"), most=MAX_LIMIT, by="r"
    ).collect()
    named = sorted({row["block"] for row in first})
    if not named or len(named) > MAX_NAMED_BLOCKS:
        return None
    terms = [*frequent, *others]
    best = _from_postings(batch, store, analyzer, model, weights, terms, named)
    last = {
        row["request_id"]: row["least"]
        for row in best.groupBy("request_id").agg(F.count("*").alias("n"), F.min("fts_score").alias("least"))
        .join(batch.frame.select("request_id", "limit"), "request_id").where(F.col("n") >= F.col("limit")).collect()
    }
    reach = [
        {"r": n, "reach": max(last.get(row["request_id"], 0.0), row["min_score"] or 0.0) - _SLACK}
        for n, row in enumerate(batch.rows)
    ]
    spark = batch.frame.sparkSession
    reached = bounds.join(F.broadcast(local_frame(spark, reach, _REACH)), "r").where(F.col("bound") >= F.col("reach"))
    kept = reached.select("block").distinct().limit(MAX_NAMED_BLOCKS + 1).collect()
    return sorted(row["block"] for row in kept) if len(kept) <= MAX_NAMED_BLOCKS else None


def _from_postings(
    batch: Batch,
    store: Store,
    analyzer: Analyzer,
    model: Bm25,
    weights: DataFrame,
    named: list[str],
    blocks: list[int] | None = None,
) -> DataFrame:
    """Join postings with query terms and sum per (request, chunk), of some blocks or of all.

    Postings are bucketed by chunk, so the sum needs no shuffle; what moves is each task's best
    100 rows per request. Requests are numbered: a number is cheaper than a name in group keys.
    """
    corpus, postings = store.corpus(analyzer), store.postings(analyzer).where(_among(named))
    if blocks is not None:
        postings = postings.where(F.col("block").isin(blocks))
    params = F.broadcast(batch_frame(batch))
    matches = postings.join(weights, "term")
    if any(row["allowed_ciks"] is not None for row in batch.rows):
        matches = matches.join(params, "r").where(passes_filter(F.col("allowed_ciks"), F.col("cik")))
    part = model.idf(corpus["n_chunks"], F.col("df")) * model.saturation(
        F.col("tf"), F.col("dl"), corpus["avgdl"] or 1.0
    )
    scored = matches.groupBy("r", "chunk_id").agg(F.sum(part).alias("fts_score"))
    # A minimum of 0 means none was asked for.
    enough = F.coalesce(F.nullif("min_score", F.lit(0.0)) <= F.col("fts_score"), F.lit(True))
    best = top_ranked(
        scored.join(params, "r").where(enough).select("r", "chunk_id", "fts_score", "limit"),
        settled(F.col("fts_score")).desc(),
        F.col("chunk_id"),
        limit=F.col("limit"),
        by="r",
        tasks=store.posting_tasks(),
    )
    return best.drop("limit").join(params, "r").select("request_id", "chunk_id", "fts_score", "rank")


def _from_chunks(
    batch: Batch, store: Store, analyzer: Analyzer, model: Bm25, weights: list[Row]
) -> DataFrame:
    """Score every chunk for all requests where its terms are read."""
    corpus = store.corpus(analyzer)
    entries = [
        (row["term"], row["r"], model.idf_value(corpus["n_chunks"], row["df"])) for row in weights
    ]
    cutoffs = [-row["min_score"] if row["min_score"] else None for row in batch.rows]
    search = best_keyword_scores(
        *batch.columns(cutoffs), TermWeights(entries), model.k1, model.b, corpus["avgdl"] or 1.0
    )
    chunks = store.forward(analyzer).where("linked")
    ciks = batch.filtered_ciks
    if ciks is not None:
        chunks = chunks.where(F.col("cik").isin(ciks))
    candidates = chunks.select(
        "chunk_id", "cik", "dl", F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf")
    ).mapInArrow(search, CANDIDATES)
    limits = F.broadcast(batch.frame.select("request_id", "limit"))
    return top_ranked(
        candidates.join(limits, "request_id").withColumn("fts_score", -F.col("cost")),
        F.col("key"),
        F.col("chunk_id"),
        limit=F.col("limit"),
        tasks=store.passage_tasks(),
    ).select("request_id", "chunk_id", "fts_score", "rank")


def _among(terms: list[str]) -> Column:
    """``term IN (...)`` as one parsed expression; building thousands of literals singly is slow."""
    if not terms:
        return F.lit(False)
    quoted = (t.replace("\\", "\\\\").replace("'", "\\'") for t in terms)
    return F.expr("term IN (" + ", ".join(f"'{t}'" for t in quoted) + ")")


def batch_frame(batch: Batch) -> DataFrame:
    """The requests of a batch by their numbers."""
    return local_frame(batch.frame.sparkSession, _numbered(batch), _PARAMS)


def _numbered(batch: Batch) -> list[dict]:
    names = [field.name for field in _PARAMS if field.name != "r"]
    return [{"r": n, **{name: row[name] for name in names}} for n, row in enumerate(batch.rows)]


def bm25_search(
    requests: DataFrame,
    store: Store,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
    weigh: bool | None = None,
) -> DataFrame:
    """Keyword search for a request table; see ``RESULT_COLUMNS``."""
    return in_batches(
        requests,
        store.companies,
        lambda batch: label_hits(bm25_hits(batch, store, analyzer, model, weigh), store, "fts", batch=batch),
        shared_pass=True,
    )
