"""Compact codes of vectors: four bits a value after a fixed random rotation.

Rotation spreads a vector's length evenly over its values, so one step size fits all. An estimate of
a cosine is the product of the rotated query with the code, over a factor kept per vector that makes
it right on average; its error falls with the number of values.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from gleaner.functions.blocks import BestOfAll, TaskFunction

# Executors need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = 16
SPREAD = 2.6  # standard deviations that the levels cover on each side
_ROWS = 4096
_CELLS = 1_000_000
_BREAK = "\x00"  # between a chunk's id and its list, which go through the selection as one name


@dataclass(frozen=True)
class Coder:
    """The same rotation for rows and requests, drawn from a seed."""

    dimensions: int
    seed: int

    @cached_property
    def rotation(self) -> np.ndarray:
        drawn = np.random.default_rng(self.seed).normal(size=(self.dimensions, self.dimensions))
        return np.linalg.qr(drawn)[0].astype(np.float32)

    @property
    def step(self) -> float:
        return 2.0 * SPREAD / np.sqrt(self.dimensions) / LEVELS

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes, a line per unit vector, and their factors."""
        turned = units.astype(np.float32) @ self.rotation
        levels = np.clip(np.floor(turned / self.step) + LEVELS // 2, 0, LEVELS - 1).astype(np.uint8)
        factors = ((levels.astype(np.float32) - (LEVELS - 1) / 2) * turned).sum(axis=1)
        if self.dimensions % 2:
            levels = np.pad(levels, ((0, 0), (0, 1)))
        return levels[:, ::2] << 4 | levels[:, 1::2], factors

    def decode(self, packed: np.ndarray) -> np.ndarray:
        levels = np.empty((len(packed), packed.shape[1] * 2), np.float32)
        levels[:, ::2] = packed >> 4
        levels[:, 1::2] = packed & 15
        return levels[:, : self.dimensions] - (LEVELS - 1) / 2


def best_possible(queries: np.ndarray, centroids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per request and list the largest cosine that a vector of the list can have with the request.

    ``least`` is the smallest cosine of a list's vectors with its centroid: no vector is further away
    from the request, as angles go, than the centroid less that.
    """
    apart = np.arccos(np.clip(queries @ centroids.T, -1.0, 1.0))
    reach = np.arccos(np.clip(least, -1.0, 1.0))
    return np.cos(np.maximum(apart - reach, 0.0))


def assign_lists(centroids: np.ndarray, coder: Coder) -> TaskFunction:
    """Vectors with the list of their nearest centroid, their cosine with it, code and factor."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                matrix = matrix.astype(np.float64).reshape(batch.num_rows, -1)
                units = matrix / batch.column("norm").to_numpy(zero_copy_only=False)[:, None]
                cosines = units @ centroids.T
                nearest = np.argmax(cosines, axis=1).astype(np.int32)
                cosine = cosines[np.arange(len(units)), nearest]
                packed, factors = coder.encode(units)
                codes = pa.array([row.tobytes() for row in packed], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest), pa.array(cosine), codes, pa.array(factors)],
                    [*batch.schema.names, "list", "cosine", "code", "factor"],
                )

    return assign


def nearest_codes(
    ids, limits, allowed, queries: np.ndarray, probes: np.ndarray, coder: Coder
) -> TaskFunction:
    """``(request_id, chunk_id, list, key)`` of the rows that seem nearest to each request.

    ``probes`` has a line per request and a column per list: whether the request looks there.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = queries.astype(np.float32) @ coder.rotation
        best = BestOfAll(ids, limits, [None] * len(ids), allowed)
        rows = max(1, min(_ROWS, _CELLS // max(1, len(ids))))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
                values = coder.decode(packed.reshape(batch.num_rows, -1))
                factors = batch.column("factor").to_numpy(zero_copy_only=False)
                with np.errstate(divide="ignore", invalid="ignore"):
                    costs = 1.0 - (turned @ values.T).astype(np.float64) / factors
                lists = batch.column("list")
                looks = probes[:, lists.to_numpy(zero_copy_only=False)]
                names = pc.binary_join_element_wise(batch.column("chunk_id"), lists.cast(pa.string()), _BREAK)
                best.offer(costs, looks & ~np.isnan(costs), names, batch.column("cik"))
        found = best.batch()
        names = [name.rsplit(_BREAK, 1) for name in found.column("chunk_id").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                found.column("request_id"),
                pa.array([chunk for chunk, _ in names], pa.string()),
                pa.array([int(number) for _, number in names], pa.int32()),
                found.column("key"),
            ],
            ["request_id", "chunk_id", "list", "key"],
        )

    return search


def exact_distances(queries: np.ndarray) -> TaskFunction:
    """``(r, request_id, limit, chunk_id, distance)`` of rows that name a request by its number ``r``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = matrix.astype(np.float64).reshape(batch.num_rows, -1)
            asked = queries[batch.column("r").to_numpy(zero_copy_only=False)]
            norms = batch.column("norm").to_numpy(zero_copy_only=False)
            distances = 1.0 - (asked * matrix).sum(axis=1) / norms
            kept = [batch.column(name) for name in ("request_id", "limit", "cutoff", "chunk_id")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(distances)], ["request_id", "limit", "cutoff", "chunk_id", "distance"]
            )

    return measure
