"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import zlib
from collections import Counter
import re

import pytest

from gleaner.llm import spelling
from gleaner.llm.workload import misspelt


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int], ratio: int) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    found = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return found


def words_of(seed: int, letters: str, n: int) -> dict[str, int]:
    """Random words and edits of them, with counts that make chains of forms."""
    draw = random.Random(seed)
    counts: dict[str, int] = {}
    while len(counts) < n:
        word = "".join(draw.choice(letters) for _ in range(draw.randint(7, 12)))
        count = 10 ** draw.randint(1, 6)
        for _ in range(draw.randint(1, 6)):
            if len(word) >= spelling.MIN_LENGTH:
                counts.setdefault(word, max(1, count))
            at, count = draw.randrange(len(word)), count // draw.choice((1, 9, 10, 11))
            put = draw.choice(["", draw.choice(letters), word[at] + draw.choice(letters)])
            word = word[:at] + put + word[at + 1 :]
    return counts


def found_of(frame) -> dict[str, tuple]:
    rows = frame.collect()
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(("letters", "most"), [("ab", 1 << 18), ("abcdefgh", 40), ("aeioué𝒳ß", 1), ("abcdefghijklmnopqrstuvwxyz", 500)])
def test_all_pairs(spark, letters, most):
    counts = words_of(len(letters), letters, 400)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_of(spelling.variants(frame, 10, most)) == plain(counts, 10)


def test_awkward_words(spark):
    long = "ab" * 3000
    rows = [
        (None, 5),
        ("", 5),
        ("short", 50),
        ("aaaaaaa", 3),
        ("aaaaaaaa", 30),
        ("aaaaaaaa", 20),  # added up
        ("aaaaaaab", 50),  # a draw with the one before
        ("a" * 1500, 1),
        ("a" * 1501, 10),
        (long, 1),
        (long[:-1], 100),
        (long[:3000] + "x" + long[3000:], 7),
        ("with space", 1),
        ("with_space", 20),
    ]
    frame = spark.createDataFrame([(w, n, "x", 1) for w, n in rows], "word string, n long, root string, key int")
    counts = Counter()
    for word, n in rows:
        if word is not None and len(word) >= spelling.MIN_LENGTH:
            counts[word] += n
    assert found_of(spelling.variants(frame)) == plain(counts, 10)
    assert spelling.variants(frame.limit(0)).collect() == []


def test_a_family_gives_each_pair_once(spark):
    """All words that differ in the last letters: keys that many share, and pairs that meet under many keys."""
    stem = "abcdefghijk"
    family = [stem + x + y for x in "lmnopqrs" for y in "lmnopqrs"]
    words = spark.createDataFrame([(w, 1) for w in family], "word string, n long")
    pairs = spelling.near_pairs(words, spelling.gram_dictionary(words)).collect()
    assert len({(r["word"], r["near"]) for r in pairs}) == len(pairs)
    assert len(pairs) == sum(one_edit(a, b) for a in family for b in family if a < b)


def test_shortest_words_keep_two_grams():
    """Whatever the dictionary holds, one edit leaves two grams of a word of the least length."""
    draw = random.Random(5)
    for _ in range(3000):
        word = "".join(draw.choice("abc") for _ in range(spelling.MIN_LENGTH))
        grams = {a + b + c for a in "abc\x02" for b in "abc" for c in "abc\x03" if draw.random() < 0.5}
        dictionary = spelling.GramDictionary({g: spelling._RARE_IDS + n for n, g in enumerate(sorted(grams))})
        marked = spelling.MARKS[0] + word + spelling.MARKS[1]
        tokens = set(spelling.tokens_of(dictionary.decompose(marked)[0]))
        changed = spelling.bound(*dictionary.decompose(marked)[1:], len(marked))
        assert len(tokens) - changed >= spelling.SHARED
        at = draw.randrange(len(word))
        other = word[:at] + draw.choice(["", "a", "ba", "cc"]) + word[at + 1 :]
        kept = set(spelling.tokens_of(dictionary.decompose(spelling.MARKS[0] + other + spelling.MARKS[1])[0]))
        assert other == word or len(other) > len(word) + 1 or len(tokens & kept) >= len(tokens) - changed or not one_edit(word, other)


def test_planted_errors(spark):
    texts = [(i, "Unterschied Überraschung déjà-vu ABCDEFGH abcdefgh " * (i % 3 + 1)) for i in range(200)]
    texts += [(None, "Unterschied"), (7, None), (8, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    assert {r["word"]: r["n"] for r in misspelt(frame).collect()} == counts
