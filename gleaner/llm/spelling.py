"""Spelling variants: words that one inserted, deleted or replaced code point tells apart.

A gram index of variable length finds them. The dictionary holds the grams of two and three code
points that are frequent among the words; rarer three-point grams are folded into their first two.
A word, with a mark at each end, is decomposed from left to right into the longest grams of the
dictionary that do not lie inside the gram before. One edit can only change the grams near it; the
most that one edit anywhere in the word can change is the word's own bound. Near words therefore
share all other grams: at least ``grams - bound`` of them.

Lists are merged on two grams at a time. Grams have one order, rare ones first. Of a word that keeps
``T >= 2`` grams, ``bound + 2`` first grams are enough to meet every near word in two of them, and those two
are the key of a join. A pair of words meets under many keys; it is taken under the first two grams
that both have, which a row can tell from the grams it skipped. What meets is verified by its edit
distance inside the join.

Words of fewer than ``MIN_LENGTH`` code points do not keep two grams after an edit and are left out,
as are null words; counts of repeated rows are added up. Very long words are words like others. An
empty table gives an empty result. Results have the columns of ``RESULT`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.shared import require, ship, shipped, written

MIN_LENGTH = 7
SHORT, LONG = 2, 3  # code points of a gram
SHARED = 2  # grams of a key
MOST_GRAMS = 1 << 18  # of the dictionary: what is rarer than its share of all grams is pruned
MARKS = ("\x02", "\x03")  # begin and end

_OCCURRENCE_BITS = 10
_RARE_IDS = 1 << 18  # ids of short grams that the dictionary lacks
_INDEX = "key long, skipped array<int>, letters long, word string, n long"
RESULT = ("word", "n", "n_near", "form", "form_n", "root")


def fnv(text: str) -> int:
    """A 32-bit hash that is the same in all workers."""
    h = 2166136261
    for byte in text.encode():
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return h


@dataclass
class GramDictionary:
    """Gram to id; ids follow the global order, rare grams first."""

    ids: dict[str, int]
    rare: dict[str, int] = field(default_factory=dict)

    def id_of(self, gram: str) -> int:
        found = self.ids.get(gram)
        if found is None:
            found = self.rare.get(gram)
            if found is None:
                # equal ids of unlike grams only make words look more alike, which is verified
                found = self.rare[gram] = fnv(gram) % _RARE_IDS
        return found

    def decompose(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, first and last places of a marked word's grams."""
        ids, first, last = [], [], []
        reach = -1
        for p in range(len(word) - SHORT + 1):
            gram = word[p : p + LONG]
            if len(gram) == SHORT or gram not in self.ids:
                gram = gram[:SHORT]
            if p + len(gram) - 1 > reach:
                reach = p + len(gram) - 1
                ids.append(self.id_of(gram))
                first.append(p)
                last.append(reach)
        return ids, first, last


def bound(first: list[int], last: list[int], length: int) -> int:
    """The most grams that one edit inside a marked word of this length can change.

    Replacing or deleting place ``i`` can change a gram that begins in the ``LONG`` places up to
    ``i`` (its longest match looks there), or begins later but ends where a changed gram may reach and
    swallow it. Inserting before ``i`` does so with one place less on each side, so it is covered.
    """
    most = 0
    for i in range(1, length - 1):
        changed = 0
        for p, e in zip(first, last):
            if p > i + LONG - 1:
                break
            if i - LONG < p <= i or (p > i and e <= i + LONG - 1):
                changed += 1
        most = max(most, changed)
    return most


def tokens_of(ids: list[int]) -> list[int]:
    """Grams of a word as a set, in the global order: repeated grams are numbered.

    Numbers end at a limit; what two words share falls by no more than what an edit changes, all the same.
    """
    met: dict[int, int] = {}
    tokens = set()
    for i in ids:
        n = met.get(i, 0)
        met[i] = n + 1
        tokens.add(i << _OCCURRENCE_BITS | min(n, (1 << _OCCURRENCE_BITS) - 1))
    return sorted(tokens)


def keys_of(word: str, dictionary: GramDictionary) -> list[tuple[int, list[int]]]:
    """The keys of a word, each with the grams before its second one that it skips."""
    marked = MARKS[0] + word + MARKS[1]
    ids, first, last = dictionary.decompose(marked)
    tokens = tokens_of(ids)
    changed = bound(first, last, len(marked))
    if len(tokens) - changed < SHARED:
        raise ValueError(f"a word keeps fewer than {SHARED} grams: {word!r}")
    head = tokens[: changed + SHARED]
    return [
        (head[i] << 32 | head[j], head[:i] + head[i + 1 : j]) for j in range(1, len(head)) for i in range(j)
    ]


def letters_of(word: str) -> int:
    """Which code points a word has, modulo 64, as bits of a signed number.

    An edit takes at most one bit away and adds at most one.
    """
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def gram_dictionary(words: DataFrame, most: int = MOST_GRAMS) -> GramDictionary:
    """The frequent grams of a table of words, ``most`` at the most.

    A gram stays if it occurs at least once in ``total / most`` grams. A short gram counts in the
    order by what its kept longer forms leave of it.
    """
    marked = F.concat(F.lit(MARKS[0]), "word", F.lit(MARKS[1]))
    places = words.select(marked.alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("p"))
    grams = places.select(F.col("w").substr(F.col("p"), F.lit(LONG)).alias("gram"))
    counted = written(grams.groupBy("gram").count(), "grams")
    both = counted.where(F.length("gram") == LONG).unionByName(
        counted.groupBy(F.substring("gram", 1, SHORT).alias("gram")).agg(F.sum("count").alias("count"))
    )
    total = both.agg(F.sum("count")).first()[0] or 0
    least = max(1, -(-total // most))
    # no more than ``most`` rows, as each stands for ``least`` of ``total``
    kept = {row["gram"]: row["count"] for row in both.where(F.col("count") >= least).collect()}
    left = dict(kept)
    for gram, count in kept.items():
        if len(gram) == LONG and gram[:SHORT] in left:
            left[gram[:SHORT]] -= count
    ordered = sorted(kept, key=lambda gram: (left[gram], gram))
    return GramDictionary({gram: _RARE_IDS + n for n, gram in enumerate(ordered)})


def keyed(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """``(key, skipped, letters, word, n)``: the rows of the index, a few per word."""
    shared = ship(words.sparkSession, dictionary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: GramDictionary = shipped(shared)
        if len(grams.rare) > MOST_GRAMS:
            grams.rare.clear()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keys, skipped, counts, letters = [], [], [], []
                for word in batch.column("word").to_pylist():
                    letters.append(letters_of(word))
                    found = keys_of(word, grams)
                    counts.append(len(found))
                    for key, before in found:
                        keys.append(key)
                        skipped.append(before)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(skipped, pa.list_(pa.int32())),
                        pa.array(letters, pa.int64()).take(rows),
                        batch.column("word").take(rows),
                        batch.column("n").take(rows),
                    ],
                    ["key", "skipped", "letters", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(index, _INDEX)


def near_pairs(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """``(word, n, near, near_n)`` of all words one edit apart, each pair once, ``word < near``."""
    rows = keyed(words, dictionary)
    a, b = rows.alias("a"), rows.alias("b")
    meets = (
        (F.col("a.key") == F.col("b.key"))
        # cheap tests first: few of those who meet are near
        & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2)
        & (F.col("a.word") < F.col("b.word"))
        & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
        & ~F.arrays_overlap("a.skipped", "b.skipped")
    )
    return a.join(b, meets).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)`` links that lead to no circle, by jumps of doubling length."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        jumped = now.join(step, F.col("root") == F.col("via"), "left")
        jumped = jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved"))
        jumped = written(jumped, "roots")
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        now = jumped.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, most: int = MOST_GRAMS) -> DataFrame:
    """Words of a ``(word, n)`` table with ``RESULT``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (the smallest on a
    draw) if it is at least ``ratio`` times as frequent as the word; ``root`` is where forms lead to.
    """
    require(words, "word", "n")
    if ratio < 2:
        raise ValueError("forms of forms end only with a ratio of 2 or more")
    usable = words.where(F.length("word") >= MIN_LENGTH).select("word", F.col("n").cast("long").alias("n"))
    usable = written(usable.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(usable, gram_dictionary(usable, most))
    sides = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    found = usable.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= F.col("n") * ratio, F.col("best.near")).alias("form"),
        F.when(form_n >= F.col("n") * ratio, form_n).alias("form_n"),
    )
    found = written(found, "forms")
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").withColumn("root", F.coalesce("root", "word")).select(*RESULT)
