"""Vectorised word hashing agrees with hashing word by word, however texts are cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

import brute
from gleaner.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0bz\U0001f600", max_size=40)), max_size=30)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([3, 11, 1 << 21]))
def test_hashes_of_words(texts, chunk):
    before, W.CHUNK_BYTES = W.CHUNK_BYTES, chunk
    try:
        seen = 0
        for first, last, hashes, bounds in W.word_chunks(pa.array(texts, pa.string())):
            assert first == seen
            seen = last
            for row in range(first, last):
                found = hashes[bounds[row - first] : bounds[row - first + 1]].tolist()
                assert found == [W.hash_text(w) for w in brute.words(texts[row])]
        assert seen == len(texts)
    finally:
        W.CHUNK_BYTES = before


def test_sliced_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1, 3)
    counts = [n for _, _, _, bounds in W.word_chunks(column) for n in np.diff(bounds).tolist()]
    assert counts == [0, 1, 3]


def test_deal_keeps_every_row():
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    dealt = [W.joined([c[0]], np.uint64) for _, c in W.deal(W.shard_of(keys, 7), keys)]
    assert sorted(np.concatenate(dealt).tolist()) == sorted(keys.tolist())
