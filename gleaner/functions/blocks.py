"""Task functions: many requests at once over Arrow batches, with NumPy.

Used where a batch of requests would multiply rows inside Spark. A task reads its rows once, keeps
the best of every request while it does, and hands on at most ``limit`` rows per request.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 9
_CELLS_PER_BLOCK = 1_000_000
_LEAST_ROWS = 200  # of a block, however many requests there are
CANDIDATES = "request_id string, chunk_id string, cost double, key double"

TaskFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Best:
    """The cheapest chunks of one request so far, as ``(rounded cost, chunk id, cost)``."""

    def __init__(self, limit: int, cutoff: float | None, allowed: frozenset[str] | None):
        self.limit = limit
        self.cutoff = np.inf if cutoff is None else cutoff
        self.allowed = None if allowed is None else sorted(allowed)
        self.rows: list[tuple[float, str, float]] = []

    @property
    def bound(self) -> float:
        """Rounded costs above this cannot enter any more."""
        return self.rows[-1][0] if len(self.rows) == self.limit else np.inf

    def offer(self, cost: np.ndarray, keys: np.ndarray, ids: pa.Array, passing: np.ndarray) -> None:
        rows = np.flatnonzero(passing & (keys <= self.bound) & (cost <= self.cutoff))
        if len(rows) > self.limit:
            edge = np.partition(keys[rows], self.limit - 1)[self.limit - 1]
            rows = rows[keys[rows] <= edge]
        if len(rows):
            # only the names of rows that may stay become Python objects
            names = ids.take(pa.array(rows)).to_pylist()
            offered = list(zip(keys[rows].tolist(), names, cost[rows].tolist()))
            self.rows = sorted(self.rows + offered)[: self.limit]


class BestOfAll:
    """The best rows of every request of a batch."""

    def __init__(self, ids: Sequence[str], limits, cutoffs, allowed):
        self.ids = ids
        self.best = [Best(*given) for given in zip(limits, cutoffs, allowed)]

    def offer(self, costs: np.ndarray, passing: np.ndarray, chunk_ids: pa.Array, ciks: pa.Array) -> None:
        """``costs`` and ``passing`` hold a line per request and a column per chunk.

        The rounded cost goes on as ``key``: it is rounded here and nowhere else, so rows that draw
        are ranked after the tasks as they were in them.
        """
        keys = np.round(costs, DIGITS)
        bounds = np.array([b.bound for b in self.best])[:, None]
        # NaN compares false, so directionless vectors never pass.
        near = passing & (keys <= bounds)
        coded = pc.fill_null(ciks, "").dictionary_encode()
        names, name_of_row = np.array(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        for n in np.flatnonzero(near.any(axis=1)):
            open_rows, best = near[n], self.best[n]
            if best.allowed is not None:
                open_rows = open_rows & np.isin(names, best.allowed)[name_of_row]
            best.offer(costs[n], keys[n], chunk_ids, open_rows)

    def batch(self) -> pa.RecordBatch:
        found = [(i, c, d, k) for i, b in zip(self.ids, self.best) for k, c, d in b.rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row[0] for row in found], pa.string()),
                pa.array([row[1] for row in found], pa.string()),
                pa.array([row[2] for row in found], pa.float64()),
                pa.array([row[3] for row in found], pa.float64()),
            ],
            names=["request_id", "chunk_id", "cost", "key"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], requests: int) -> Iterator[pa.RecordBatch]:
    """Slices for which a line per request stays within the block size."""
    rows = max(_LEAST_ROWS, _CELLS_PER_BLOCK // max(1, requests))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def nearest_vectors(ids, limits, cutoffs, allowed, queries: np.ndarray) -> TaskFunction:
    """Cosine distance of ``(chunk_id, cik, embedding, norm)`` rows; ``queries`` are unit length."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestOfAll(ids, limits, cutoffs, allowed)
        for piece in _pieces(batches, len(ids)):
            matrix = piece.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = matrix.astype(np.float64).reshape(piece.num_rows, queries.shape[1])
            norms = piece.column("norm").to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore", invalid="ignore"):
                distances = 1.0 - (queries @ matrix.T) / norms
            best.offer(
                distances,
                ~np.isnan(distances),
                piece.column("chunk_id"),
                piece.column("cik"),
            )
        yield best.batch()

    return search


class TermWeights:
    """Query terms with the requests that ask for them: entries of term n lie between two pointers."""

    def __init__(self, entries: Sequence[tuple[str, int, float]]):
        ordered = sorted(entries)
        self.terms = sorted({term for term, _, _ in ordered})
        number = {term: n for n, term in enumerate(self.terms)}
        counts = np.bincount([number[term] for term, _, _ in ordered], minlength=len(self.terms))
        self.pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.request = np.array([r for _, r, _ in ordered], dtype=np.int64)
        self.idf = np.array([idf for _, _, idf in ordered], dtype=np.float64)


def best_keyword_scores(
    ids, limits, cutoffs, allowed, weights: TermWeights, k1: float, b: float, avgdl: float
) -> TaskFunction:
    """Negative BM25 score of ``(chunk_id, cik, dl, term[], tf[])`` rows, one row per chunk."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(weights.terms, pa.string())
        best = BestOfAll(ids, limits, cutoffs, allowed)
        for piece in _pieces(batches, len(ids)):
            rows = piece.num_rows
            lists = piece.column("term")
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            row_of = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            hit = np.flatnonzero(found >= 0)
            term, row = found[hit], row_of[hit]
            tf = piece.column("tf").flatten().to_numpy()[hit].astype(np.float64)
            dl = piece.column("dl").to_numpy().astype(np.float64)[row]
            part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))
            # One entry per (matching term, request asking for it).
            fan = weights.pointers[term + 1] - weights.pointers[term]
            source = np.repeat(np.arange(len(hit)), fan)
            first = np.repeat(np.cumsum(fan) - fan, fan)
            entry = weights.pointers[term][source] + np.arange(len(source)) - first
            cell = weights.request[entry] * rows + row[source]
            scores = np.bincount(
                cell, weights=weights.idf[entry] * part[source], minlength=len(ids) * rows
            ).reshape(len(ids), rows)
            best.offer(-scores, scores > 0, piece.column("chunk_id"), piece.column("cik"))
        yield best.batch()

    return search
