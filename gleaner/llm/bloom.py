"""Bloom filters of fixed size over digests, built by Spark and read by tasks.

A filter only saves work: what passes it is joined exactly afterwards. When more digests are added
than it was made for, it lets more through, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 26  # 8 MB
PART_BITS = 20


def _places(digests: np.ndarray) -> np.ndarray:
    """Four bit positions for each 16-byte digest, which is uniform by itself."""
    return digests.reshape(-1).view(np.uint32).reshape(-1, 4) & np.uint32((1 << BITS) - 1)


def bloom_of(digests: DataFrame, column: str) -> np.ndarray:
    """A filter over a binary column of 16-byte digests; its bits are joined part by part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = b"".join(batch.column(column).to_pylist())
            at = np.unique(_places(np.frombuffer(values, np.uint8)).ravel())
            part = at >> PART_BITS
            for p in np.unique(part):
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([int(p)], pa.int32()), "at": [at[part == p].tobytes()]}
                )

    def unite(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, np.uint8)
        for at in group["at"].to_pylist():
            bits[np.frombuffer(at, np.uint32) & np.uint32((1 << PART_BITS) - 1)] = 1
        return pa.table({"part": group["part"].slice(0, 1), "bits": [np.packbits(bits).tobytes()]})

    placed = digests.select(column).mapInArrow(place, "part int, at binary")
    united = placed.groupBy("part").applyInArrow(unite, "part int, bits binary")
    whole = np.zeros((1 << (BITS - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for row in united.collect():  # at most 64 rows
        whole[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.ravel()


def may_hold_all(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """For rows of 16 bytes each, whether the filter lets them through."""
    at = _places(np.ascontiguousarray(digests).view(np.uint8))
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def may_hold(bits: np.ndarray, digest: bytes) -> bool:
    return bool(may_hold_all(bits, np.frombuffer(digest, np.uint8))[0])
