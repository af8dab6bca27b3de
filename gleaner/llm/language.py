"""Language identification by cross-parsing against suffix automata.

For every language an automaton of all substrings of a labelled sample is built. A text is parsed
from left to right into the longest phrases that occur in the sample; few phrases mean that the
language fits. Phrases of a text are counted for all languages, weighed by the bits one phrase needs
(two samples of unequal size are then comparable), and the smallest sum wins.

The sample is bounded: ``DOCS_PER_LANGUAGE`` labelled documents per language, chosen by a hash of
their id, and ``SAMPLE_CHARS`` characters per language (``TOTAL_CHARS`` for all languages). Every
text is predicted from all of its characters. Automata are turned into tables, and all texts of a
batch advance one character at a time together, in blocks of ``BLOCK`` characters per lane; a phrase
ends at the end of a block, in every language alike.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language in order; repeated rows get the same answer; without labelled rows everything is ``und``.
Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.shared import require, ship, shipped, small_batches

DOCS_PER_LANGUAGE = 60
SAMPLE_CHARS = 40_000
TOTAL_CHARS = 640_000
SYMBOLS = 48  # letters told apart; rarer ones share one symbol
BLOCK = 512
LANES = 1 << 14  # blocks that advance together


def alphabet(texts: list[str]) -> dict[str, int]:
    """The most frequent letters get symbols of their own; 0 is all that is no letter, 1 any other letter."""
    counts: dict[str, int] = {}
    for text in texts:
        for c in text.lower():
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    best = sorted(counts, key=lambda c: (-counts[c], c))[: SYMBOLS - 2]
    return {c: i + 2 for i, c in enumerate(best)}


def code_table(symbols: dict[str, int]) -> np.ndarray:
    """Code point to symbol, upper and lower case alike."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = symbols.get(c.lower(), 1)
    return table


def automaton(codes: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of a symbol sequence: ``[state, symbol]``, -1 for none."""
    following: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes.tolist():
        new = len(length)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
        last = new
    table = np.full((len(following), SYMBOLS), -1, np.int32)
    for state, arcs in enumerate(following):
        for c, to in arcs.items():
            table[state, c] = to
    return table


def parser_table(transitions: np.ndarray) -> np.ndarray:
    """One step of the greedy parse as a flat table.

    Entry ``state * SYMBOLS + symbol`` holds ``next * SYMBOLS * 2 + new``: ``new`` is 1 if the phrase
    cannot go on and the symbol begins the next one. One state is added, last, in which a text
    starts and to which a symbol returns that the sample lacks: there every symbol begins a phrase.
    """
    start = len(transitions)
    first = np.where(transitions[0] < 0, start, transitions[0])
    whole = np.concatenate([transitions, np.full((1, SYMBOLS), -1, np.int32)])
    new = whole < 0
    target = np.where(new, first[None, :], whole)
    return (target.astype(np.int32) * (SYMBOLS * 2) + new).astype(np.int32).ravel()


@dataclass
class Model:
    """Languages, the alphabet and one sample per language; tables are made where they are used."""

    languages: list[str]
    symbols: dict[str, int]
    samples: list[np.ndarray]
    _tables: tuple | None = field(default=None, repr=False)

    def tables(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        if self._tables is None:
            bits = np.array([math.log2(len(s) + 2) for s in self.samples])
            steps = [parser_table(automaton(s)) for s in self.samples]
            self._tables = (code_table(self.symbols), steps, bits)
        return self._tables

    def __getstate__(self):
        return {"languages": self.languages, "symbols": self.symbols, "samples": self.samples, "_tables": None}


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text; runs of anything but letters count once."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep]


def fit(docs: DataFrame) -> Model:
    """Learn from the text and non-null ``lang`` of ``docs``, within the bounds above.

    Ids are ranked first without texts; a rank filter is applied per task before the shuffle. Then
    the few chosen texts are read.
    """
    require(docs, "doc_id", "text", "lang")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = labelled.select("lang", "doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h"))
    picked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS_PER_LANGUAGE)
    ids = [r["doc_id"] for r in picked.select("doc_id").distinct().collect()]  # bounded per language
    taken = labelled.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", "text") if ids else labelled.limit(0).select("lang", "doc_id", "text")
    one = taken.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = sorted(((r["lang"], r["doc_id"], r["text"][:SAMPLE_CHARS]) for r in one.toLocalIterator()), key=lambda r: (r[0], r[1]))
    languages = sorted({lang for lang, _, text in rows if any(map(str.isalpha, text))})
    symbols = alphabet([text for _, _, text in rows])
    table = code_table(symbols)
    most = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, len(languages)))
    samples = []
    for language in languages:
        parts = [np.append(symbols_of(text, table), 0) for lang, _, text in rows if lang == language]
        samples.append(np.concatenate(parts)[:most].astype(np.uint8))
    return Model(languages, symbols, samples)


def phrase_counts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and the number of letters of each text."""
    table, steps, _ = model.tables()
    coded = [symbols_of(text, table) for text in texts]
    letters = np.array([int((c != 0).sum()) for c in coded])
    blocks = np.array([-(-len(c) // BLOCK) for c in coded], np.int64)
    owner = np.repeat(np.arange(len(texts)), blocks)
    counts = np.zeros((len(texts), len(steps)), np.int64)
    if not len(owner):
        return counts, letters
    sizes = np.array([len(c) for c in coded], np.int64)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
    offset = (np.cumsum(sizes) - sizes)[owner] + within * BLOCK
    data = np.concatenate(coded)
    by_length = np.argsort(-length, kind="stable")
    for at in range(0, len(by_length), LANES):
        lanes = by_length[at : at + LANES]
        long, start = length[lanes], offset[lanes]
        # lanes still running at position j are a leading part, as they are sorted by length
        alive = np.searchsorted(-long, -np.arange(1, long[0] + 1), "right")
        columns = [data[start[:n] + j] for j, n in enumerate(alive.tolist())]
        for k, step in enumerate(steps):
            state = np.full(len(lanes), len(step) - SYMBOLS, np.int32)
            phrases = np.zeros(len(lanes), np.int32)
            for symbols in columns:
                n = len(symbols)
                move = step[state[:n] + symbols]
                phrases[:n] += move & 1
                state[:n] = move >> 1
            np.add.at(counts[:, k], owner[lanes], phrases)
    return counts, letters


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the winner's share of all language weights."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    counts, letters = phrase_counts(model, texts)
    cost = counts * model.tables()[2][None, :]
    best = np.argmin(cost, axis=1)
    gap = np.minimum(cost - cost.min(axis=1, keepdims=True), 700.0)
    score = 1.0 / np.exp2(-gap).sum(axis=1)
    names = [model.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters > 0, score, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    require(docs, "text")
    small_batches(docs.sparkSession, 512)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = ship(docs.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        # a worker keeps one model, and with it one set of tables, for all its tasks
        names, scores = predict_texts(shipped(shared), [t if t is not None else "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(*kept, predicted(F.col("text")).alias("_p")).select(
        *kept, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score")
    )
