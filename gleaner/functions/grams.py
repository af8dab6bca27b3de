"""Three code points in a row as one number, for whole Arrow batches with NumPy."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 3
_BITS = 21  # of a code point


def gram_numbers(text: str) -> np.ndarray:
    """The distinct grams of a text, sorted."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < WIDTH:
        return np.empty(0, np.int64)
    return np.unique(points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])


def pattern_grams(needle: str) -> list[int]:
    """Grams that every text holds which contains the needle, in which ``%`` and ``_`` are wildcards."""
    literal = re.split("[%_]", needle.lower())
    return sorted({int(g) for part in literal for g in gram_numbers(part)})


def grams_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, block, slots)`` of ``(block, slot, text)`` rows in which a block's rows lie together.

    ``slots`` has a bit for each slot, from 0 to 63, whose texts hold the gram.
    """

    def found(block: int, parts: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        grams, slots = np.concatenate(parts), np.concatenate(bits)
        order = np.argsort(grams, kind="stable")
        grams, slots = grams[order], slots[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, int)
        united = np.bitwise_or.reduceat(slots, first) if len(first) else slots
        return pa.RecordBatch.from_arrays(
            [pa.array(grams[first]), pa.array(np.full(len(first), block, np.int32)), pa.array(united.view(np.int64))],
            ["gram", "block", "slots"],
        )

    open_block, parts, bits = None, [], []
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("block", "slot", "text"))
        for block, slot, text in zip(*columns):
            if block != open_block and parts:
                yield found(open_block, parts, bits)
                parts, bits = [], []
            open_block = block
            grams = gram_numbers(text)
            parts.append(grams)
            bits.append(np.full(len(grams), 1 << slot, np.uint64))
    if parts:
        yield found(open_block, parts, bits)
