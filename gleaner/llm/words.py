"""Words of Arrow batches as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial in its bytes modulo 2**64, finished with a mixing step; it depends on
the word alone, so tables of hashes made by different tasks and runs can be joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _fold_table() -> np.ndarray:
    """Byte to value: 0 for white space, else the byte with A-Z lowered, plus one."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65 + 0 : 91] += 32
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_FOLD = _fold_table()


class Powers:
    """Powers of the base and of its inverse, kept for the next chunk but not sent with tasks."""

    def __init__(self):
        self.made: list[np.ndarray] = []

    def __getstate__(self):
        return {"made": []}

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.made or len(self.made[0]) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self.made = [
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
                for base in (_BASE, _INVERSE)
            ]
        return self.made[0], self.made[1]


powers = Powers()


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole result; a permutation of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + b)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = words[:count].copy()
    for i in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : i + count]
    return mix64(h)


def _segment(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a byte range, and for each cut the number of words that begin before it.

    A word never reaches over a cut.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    value = _FOLD[data]
    inside = value != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins[inner] = inside[inner]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(ends)
    power, inverse = powers(n)
    total = np.cumsum(value * power[:n], dtype=np.uint64)
    h = total[stop]
    h[1:] -= total[start[1:] - 1]
    if len(start) and start[0] > 0:
        h[0] -= total[start[0] - 1]
    h *= inverse[start]
    return mix64(h), np.searchsorted(start, cuts)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cut one long text at white space into pieces of about a chunk."""
    at = 0
    while at < len(data):
        to = min(len(data), at + CHUNK_BYTES)
        while to < len(data):
            spaces = np.flatnonzero(_FOLD[data[to : to + CHUNK_BYTES]] == 0)
            if len(spaces):
                to += int(spaces[0])
                break
            to = min(len(data), to + CHUNK_BYTES)
        yield data[at:to]
        at = to


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, hashes, bounds)`` for runs of rows of about ``CHUNK_BYTES``.

    Row ``first + i`` has the words ``hashes[bounds[i]:bounds[i + 1]]``. A row that is longer than a
    chunk comes alone, hashed piece by piece.
    """
    data, offsets = texts(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(rows, max(first + 1, last))
        part = data[offsets[first] : offsets[last]]
        cuts = offsets[first : last + 1] - offsets[first]
        if len(part) > CHUNK_BYTES:
            found = [_segment(piece, np.empty(0, np.int64))[0] for piece in _pieces(part)]
            hashes = np.concatenate(found)
            bounds = np.array([0, len(hashes)], np.int64)
        else:
            hashes, bounds = _segment(part, cuts)
        yield first, last, hashes, bounds
        first = last


def hash_text(word: str) -> int:
    """The hash of one word, as the vectorised code gives it."""
    return int(_segment(np.frombuffer(word.encode(), np.uint8), np.empty(0, np.int64))[0][0])


def deal(shards: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of parallel arrays, cut by shard number, as bytes."""
    order = np.argsort(shards, kind="stable")
    dealt = shards[order]
    edges = np.flatnonzero(np.diff(dealt)) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(shards[part[0]]), [np.ascontiguousarray(c[part]).tobytes() for c in columns]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each hash, by its upper bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def joined(chunks: Iterable[bytes | None], dtype: type | str) -> np.ndarray:
    """Byte strings of one shard as one array."""
    return np.frombuffer(b"".join(c for c in chunks if c), dtype)
