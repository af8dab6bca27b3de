"""Cheap tests before exact ones may let too much through, and never drop a link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gleaner.llm.near_lines import _looking_back, _meetings, _sign
from gleaner.llm.near_sets import SignatureTree, signature_of, spanning_links


def test_signature_tree_keeps_all_links():
    draw = np.random.default_rng(0)
    for size in (12, 120, 300):  # also across the sizes at which signatures get wider
        base = draw.integers(0, 2**63, size, dtype=np.uint64)
        sets = []
        for _ in range(150):
            kept = base[draw.random(size) > draw.random() * 0.2]
            more = draw.integers(0, 2**63, draw.integers(0, size // 6 + 1), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([kept, more])))
        sets.sort(key=len)
        sizes = np.array([len(s) for s in sets])
        tree = SignatureTree(sizes, [signature_of(s) for s in sets], np.arange(len(sets)))
        found = {(min(x, y), max(x, y)) for i, j in tree.pairs(85) for x, y in zip(i.tolist(), j.tolist())}
        linked = {
            (a, b)
            for a in range(len(sets))
            for b in range(a + 1, len(sets))
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        }
        assert linked <= found
        leaders = {(min(x, y), max(x, y)) for x, near in tree.leader_pairs(85, np.arange(len(sets))) for y in near.tolist()}
        assert leaders <= found


def test_spanning_links_connect_what_all_links_connect(monkeypatch):
    draw = np.random.default_rng(2)
    for first in (1, 256):
        monkeypatch.setattr("gleaner.llm.near_sets.FIRST_PAIRS", first)
        base = draw.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.append(base[draw.random(60) > 0.13 * draw.random()], draw.integers(0, 2**63, draw.integers(0, 5), dtype=np.uint64))) for _ in range(80)]
        sets.append(np.array([7], np.uint64))
        found = spanning_links([bytes([k]) for k in range(len(sets))], sets, 85)

        def parts(pairs):
            label = list(range(len(sets)))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        similar = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        linked = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similar(a, b)]
        assert parts(found) == parts(linked) and 1 < len(set(parts(linked))) < len(sets)
        assert all(similar(a, b) for a, b in found) and len(found) == len(sets) - len(set(parts(linked)))


def test_line_signs_change_by_two_bits_an_edit():
    draw = np.random.default_rng(1)
    lines, edits = [], []
    for _ in range(200):
        words = draw.integers(0, 2**63, draw.integers(1, 400), dtype=np.uint64)
        other, n = words.copy(), int(draw.integers(0, 9))
        for _ in range(n):
            at, kind = draw.integers(len(other) + 1), draw.integers(3)
            new = draw.integers(0, 2**63, 1 if kind else 0, dtype=np.uint64)
            other = np.concatenate([other[:at], new, other[at + (kind != 1) :]])
        lines += [words, other]
        edits.append(n)
    batch = pa.RecordBatch.from_pydict(
        {"digest": [bytes([i % 256]) for i in range(len(lines))], "ord": list(range(len(lines))), "words": [x.tobytes() for x in lines]}
    )
    [signed] = _sign(iter([batch]))
    signs = np.stack([signed.column(f"s{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
    for k, n in enumerate(edits):
        assert np.bitwise_count(signs[2 * k] ^ signs[2 * k + 1]).sum() <= 2 * n


def test_lines_with_many_shared_grams_meet_few_times(spark):
    """Every pair that meets anywhere is still found; it no longer comes once for each gram it shares."""
    draw = np.random.default_rng(3)
    base, rows = draw.integers(0, 2**62, 30).tolist(), []
    for line in range(40):
        grams = [int(draw.integers(0, 2**62)) if draw.random() < 0.15 else g for g in base]
        grams[20:20] = base[:2] * (line % 5 == 0)  # some n-grams come twice in a line
        places = [5 * k + (line % 4 == 1) * (k > line % 20) for k in range(len(grams))]  # words put in on the way
        n = 200 + line % 3
        rows += [(g, bytes([line]), at, n, line, 0, 0, 0, 0) for g, at in zip(grams, places)]
    schema = "gram long, digest binary, at int, n int, ord long, s0 long, s1 long, s2 long, s3 long"
    found = _looking_back(spark.createDataFrame(rows, schema)).cache()
    later = found.where("ord % 3 > 0")
    pairs = [(r["ord"], r["earlier"]) for r in _meetings(later, found, 25).select("ord", "earlier").collect()]
    by_gram: dict = {}
    for g, _, at, n, line, *_ in rows:
        by_gram.setdefault(g, []).append((line, at, n))
    meetings = [
        (x, y)
        for same in by_gram.values()
        for x, at, n in same
        for y, other, m in same
        if y < x and x % 3 > 0 and abs(at - other) <= min(n, m) // 25
    ]
    assert set(pairs) == set(meetings) and len(set(pairs)) > 300
    assert len(pairs) < 2 * len(set(meetings)) < len(meetings) / 2
