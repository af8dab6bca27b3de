"""Unscored substring search, for corpora without postings.

Small corpora are read whole, and larger ones that have no index: it takes several times what reading all
passages for a batch does, so a search uses one that was written (``Store.write_grams``) but writes none
unless told to. An index of three code points in a row names the blocks that can hold a pattern: those that
have its rarest grams in the same chunks. Their passages alone are read, and the text decides. Patterns
without three code points between wildcards have no gram; for these, and for patterns that can be nearly
everywhere, all passages are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gleaner.functions.grams import pattern_grams
from gleaner.functions.text import contains_ci
from gleaner.operators.bm25 import Bm25, bm25_search
from gleaner.operators.ranking import label_hits, top_ranked
from gleaner.operators.requests import Batch, in_batches, local_frame
from gleaner.plans.store import Analyzer, Store

# Patterns of one array expression; a batch's arrays are all part of one projection.
_PATTERNS_PER_ARRAY = 100
_GRAMS_AT_ONCE = 2_000
_BLOCK = StructType([StructField("block", IntegerType())])
_LOOKED = StructType(
    [StructField("request_id", StringType()), StructField("gram", LongType()), StructField("wanted", IntegerType())]
)


# Chunks from which on the index is used: fewer are read in less time than it takes to look up blocks.
INDEX_FROM = 2_000_000
RAREST = 8  # grams of a pattern that are looked up
# Where more than this share of all blocks can hold a pattern, all passages are read for it.
COMMON_SHARE = 0.5
MAX_NAMED_BLOCKS = 2_000
MOST_BLOCKS = 500_000  # of a batch, held by the driver and broadcast


def _matches(row: Row) -> Column:
    condition = contains_ci(F.col("chunk_text"), row["query"])
    if row["allowed_ciks"] is not None:
        condition &= F.col("cik").isin(row["allowed_ciks"])
    return F.when(condition, F.struct(F.lit(row["request_id"]).alias("id"), F.lit(row["limit"]).alias("k")))


def substring_hits(batch: Batch, store: Store, indexed: bool | None = None) -> DataFrame:
    """Ranked ``(request_id, chunk_id, rank)``, in chunk order.

    Each pattern is a literal condition on the passage row, and a row emits only the requests it
    matches. ``min_score`` plays no part: there is no score. ``indexed`` overrules the size of the
    corpus, and writes the index where there is none.
    """
    if not batch.rows:
        return batch.empty("request_id string, chunk_id string, rank int")
    if indexed is None:
        indexed = store.chunk_count() >= INDEX_FROM and store.has_grams()
    if not indexed:
        return _verified(batch, store.passages().where("linked"), store.passage_tasks())
    answered, blocks = candidate_blocks(batch, store)
    parts = [_verified(batch.where(lambda row: row["request_id"] not in answered), store.passages().where("linked"), store.passage_tasks())]
    found = batch.where(lambda row: row["request_id"] in answered)
    if found.rows and blocks:
        directories = sorted({block % store.part_count() for block in blocks})
        passages = store.passages().where(F.col("part").isin(directories))
        if len(blocks) <= MAX_NAMED_BLOCKS:
            passages = passages.where(F.col("block").isin(blocks))
        else:
            held = local_frame(found.frame.sparkSession, ({"block": block} for block in blocks), _BLOCK)
            passages = passages.join(F.broadcast(held), "block", "left_semi")
        parts.append(_verified(found, passages.where("linked")))
    return reduce(DataFrame.unionByName, parts)


def candidate_blocks(batch: Batch, store: Store) -> tuple[frozenset[str], list[int]]:
    """The requests that the index answers, and all blocks that have the rarest grams of a pattern of theirs.

    Requests come in the order of how few blocks they need; those with which there would be more than
    ``MOST_BLOCKS`` are not answered, nor are patterns without grams, or that most blocks can hold.
    """
    spark = batch.frame.sparkSession
    grams = {row["request_id"]: pattern_grams(row["query"]) for row in batch.rows}
    asked = sorted({gram for own in grams.values() for gram in own})
    counts: dict[int, int] = {}
    for at in range(0, len(asked), _GRAMS_AT_ONCE):
        part = store.gram_counts().where(F.col("gram").isin(asked[at : at + _GRAMS_AT_ONCE]))
        counts |= {row["gram"]: row["n"] for row in part.collect()}
    rarest = {
        request: sorted(own, key=lambda gram: (counts.get(gram, 0), gram))[:RAREST] for request, own in grams.items() if own
    }
    # a gram that no block has leaves nothing to read
    answered = {request for request, own in rarest.items() if own[0] not in counts}
    looked = {request: own for request, own in rarest.items() if request not in answered}
    pairs = [{"request_id": r, "gram": gram, "wanted": len(own)} for r, own in looked.items() for gram in own]
    if not pairs:
        return frozenset(answered), []
    found = (
        store.grams()
        .where(F.col("gram").isin(sorted({pair["gram"] for pair in pairs})))
        .groupBy("gram", "block")
        .agg(F.bit_or("slots").alias("slots"))
        .join(F.broadcast(local_frame(spark, pairs, _LOOKED)), "gram")
        .groupBy("request_id", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted"), F.bit_and("slots").alias("slots"))
        .where((F.col("n") == F.col("wanted")) & (F.col("slots") != 0))
    )
    needs = {row["request_id"]: row["count"] for row in found.groupBy("request_id").count().collect()}
    total, chosen = 0, []
    for request in sorted(looked, key=lambda request: (needs.get(request, 0), request)):
        total += needs.get(request, 0)
        if total > MOST_BLOCKS or needs.get(request, 0) > COMMON_SHARE * store.block_count():
            break
        chosen.append(request)
    held = found.where(F.col("request_id").isin(chosen)).select("block").distinct()
    blocks = sorted(row["block"] for row in held.collect()) if chosen else []
    return frozenset(answered | set(chosen)), blocks


def _verified(batch: Batch, passages: DataFrame, tasks: int = 0) -> DataFrame:
    """The matches among some passages."""
    if not batch.rows:
        return batch.empty("request_id string, chunk_id string, rank int")
    ciks = batch.filtered_ciks
    if ciks is not None:
        passages = passages.where(F.col("cik").isin(ciks))
    matched = [
        F.array_compact(F.array(*[_matches(row) for row in batch.rows[start : start + _PATTERNS_PER_ARRAY]]))
        for start in range(0, len(batch.rows), _PATTERNS_PER_ARRAY)
    ]
    every = matched[0] if len(matched) == 1 else F.concat(*matched)
    found = passages.select("chunk_id", F.explode(every).alias("hit")).select(
        F.col("hit.id").alias("request_id"), "chunk_id", F.col("hit.k").alias("limit")
    )
    return top_ranked(found, F.col("chunk_id"), limit=F.col("limit"), tasks=tasks).drop("limit")


def substring_search(requests: DataFrame, store: Store, indexed: bool | None = None) -> DataFrame:
    """Substring search for a request table; see ``RESULT_COLUMNS``."""
    return in_batches(
        requests,
        store.companies,
        lambda batch: label_hits(substring_hits(batch, store, indexed), store, "fts", batch=batch),
    )


def text_search(
    requests: DataFrame,
    store: Store,
    *,
    indexed: bool | None = None,
    analyzer: Analyzer = Analyzer(),
    model: Bm25 = Bm25(),
) -> DataFrame:
    """Keyword search in a ranked store, else substring search; ``indexed`` overrules the store.

    It is what the store was opened as that decides, not what has been built or asked before.
    """
    if store.ranked if indexed is None else indexed:
        return bm25_search(requests, store, analyzer, model)
    return substring_search(requests, store)
