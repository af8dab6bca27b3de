"""Top rows per request, and the labelled result table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.requests import Batch, local_frame
from gleaner.plans.store import Store, company_names  # noqa: F401  (named here by callers)
from gleaner.schemas import MAX_LIMIT, RESULT_COLUMNS

SCORE_DIGITS = 9
TASKS_RANKED_AT_ONCE = 2_000
NAMED_HITS = 2_000  # also what parquet scans are told to look up by value, see ``Store``
_SCORES = ("fts_score", "vector_score", "distance", "combined_score")


def top_ranked(
    hits: DataFrame, *order: Column, limit: Column, by: str = "request_id", tasks: int = 0
) -> DataFrame:
    """Number each request's rows in ``order`` and keep ``limit`` of them; see ``ranked``."""
    return ranked(hits, *order, limit=limit, most=MAX_LIMIT, by=by, tasks=tasks)


def ranked(
    hits: DataFrame, *order: Column, limit: Column, most: int, by: str = "request_id", tasks: int = 0
) -> DataFrame:
    """``top_ranked`` for limits that go up to ``most``.

    The literal ceiling is redundant for the result; it lets the planner cut every task's rows
    to so many per request before they are shuffled. Where hits come from very many ``tasks``, their
    rows of one request would still be too many for the one task that ranks them, so groups of
    tasks are ranked first.
    """
    if tasks > TASKS_RANKED_AT_ONCE:
        groups = math.ceil(math.sqrt(tasks))
        hits = hits.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        hits = _cut(hits, order, limit, most, (by, "_group")).drop("_group", "rank")
    return _cut(hits, order, limit, most, (by,))


def _cut(hits: DataFrame, order: tuple[Column, ...], limit: Column, most: int, by: tuple[str, ...]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return hits.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= limit))


def settled(score: Column) -> Column:
    """Sort key that hides the last bits, which depend on summation order."""
    return F.round(score, SCORE_DIGITS)


def label_hits(
    hits: DataFrame,
    store: Store,
    method: str | None = None,
    keep: tuple[str, ...] = (),
    *,
    batch: Batch,
    methods: int = 1,
) -> DataFrame:
    """Attach text, section, document and company to ranked hits.

    ``hits`` holds at most ``limit`` rows per request and method of one bounded batch, so it is the
    broadcast side. Where the limits of a batch allow ``NAMED_HITS`` rows in all, the hits are read
    into the plan, and the passage scan names directories and chunks: inside a directory, which is
    sorted by chunk, it reads the pages that hold them. For more hits the scan prunes directories
    at run time. Without ``method`` the hits bring that column along; ``keep`` names further
    columns of theirs.
    """
    places = [F.col("chunk_id")]
    keyed = hits.withColumns({"part": store.part_of(*places), "block": store.block_of(*places)})
    passages = store.passages().where("linked")
    if methods * sum(row["limit"] for row in batch.rows) <= NAMED_HITS:
        rows = keyed.collect()
        keyed = local_frame(hits.sparkSession, (row.asDict() for row in rows), keyed.schema)
        for name in ("part", "block", "chunk_id"):
            passages = passages.where(F.col(name).isin(sorted({row[name] for row in rows})))
    labelled = (
        passages.join(F.broadcast(keyed), ["part", "block", "chunk_id"])
        .join(store.company_names(), "cik", "left")
    )
    if method is not None:
        labelled = labelled.withColumn("method", F.lit(method))
    for name in _SCORES:
        if name not in labelled.columns:
            labelled = labelled.withColumn(name, F.lit(None).cast("double"))
    return labelled.select(*RESULT_COLUMNS, *keep)
