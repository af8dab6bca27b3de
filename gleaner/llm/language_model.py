"""Language-model scoring: interpolated modified Kneser-Ney over bigrams.

Counting runs in Spark. Tasks count words and bigrams of their texts by hash and deal them to shards;
a shard's task adds up, derives continuation counts and what each context needs for its back-off
weight, and stores sorted hash arrays in the shared folder. Scoring tasks map those arrays into
memory and look up the words and bigrams of their texts in sorted order, so a model larger than
memory costs page reads, not heap.

A context's bigrams are dealt to one shard; contexts that make up a large part of all tokens are
dealt by bigram, and their few sums are added on the driver. The model's size follows the corpus:
nothing is pruned or capped.

Defined results: a null or empty text has no words and is scored as its end alone; with nothing to
learn from, every token has probability 1/(V+1) = 1; repeated rows are counted, and scored alike;
columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gleaner.llm.arrays import map_array, save_array
from gleaner.llm.shared import require, scratch, ship, shipped, small_batches, written
from gleaner.llm.words import deal, joined, pair_hash, shard_of, word_chunks

BEGIN = np.uint64(1)  # context of a first word
END = np.uint64(2)  # token that closes a text
SHARD_TOKENS = 6_000_000
MIN_SHARDS = 12
MERGE_ENTRIES = 3_000_000  # counted in a task before they are added up


@dataclass
class Discounts:
    """D1, D2 and D3+ from the numbers of entries counted once to four times."""

    once: float
    twice: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        n1, n2, n3, n4 = n
        if not (n1 and n2 and n3):
            return cls(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return cls(*(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)))

    def of_counts(self, c: np.ndarray) -> np.ndarray:
        return np.select([c <= 0, c == 1, c == 2], [0.0, self.once, self.twice], self.more)


def _token_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, last, tokens, contexts, starts)``: texts closed by END, contexts opened by BEGIN."""
    for first, last, words, bounds in word_chunks(texts):
        tokens = np.insert(words, bounds[1:], END)
        starts = bounds[:-1] + np.arange(last - first)
        contexts = np.empty_like(tokens)
        contexts[1:] = tokens[:-1]
        contexts[starts] = BEGIN
        yield first, last, tokens, contexts, starts


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one entry of each, and their summed counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if not len(keys):
        return keys, np.empty(0, np.int64), np.empty(0, np.int64)
    return ordered[edges], order[edges], np.add.reduceat(counts[order].astype(np.int64), edges)


def _bytewise(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes: ``(index, byte)``, a count above 255 as several entries."""
    index, rest = np.arange(len(counts)), counts.astype(np.int64)
    parts = []
    while len(index):
        parts.append((index, np.minimum(rest, 255).astype(np.uint8)))
        over = rest > 255
        index, rest = index[over], rest[over] - 255
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _count_words(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            words, _, counts = _added(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
            kept.clear()
            rows = list(deal(shard_of(words, shards), words, counts))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([s for s, _ in rows], pa.int32()), "words": [c[0] for _, c in rows], "counts": [c[1] for _, c in rows]}
            )

        for batch in batches:
            for _, _, tokens, _, _ in _token_chunks(batch.column("text")):
                kept.append(np.unique(tokens, return_counts=True))
                if sum(len(k[0]) for k in kept) > MERGE_ENTRIES:
                    yield emit()
        if kept:
            yield emit()

    return count


def _add_words(group: pa.Table) -> pa.Table:
    words, _, counts = _added(joined(group["words"].to_pylist(), np.uint64), joined(group["counts"].to_pylist(), np.int64))
    return pa.table(
        {
            "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
            "words": [words.tobytes()],
            "counts": [counts.tobytes()],
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(words)], pa.int64()),
        }
    )


def _heavy(shards: int, most: float):
    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                w, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_pydict({"word": pa.array(w[c > most].view(np.int64), pa.int64())})

    return heavy


def _bigram_shard(contexts: np.ndarray, keys: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    return np.where(np.isin(contexts, heavy), shard_of(keys, shards), shard_of(contexts, shards))


def _count_bigrams(shards: int, heavy: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            contexts, words, counts = (np.concatenate([k[i] for k in kept]) for i in range(3))
            kept.clear()
            keys, at, counts = _added(pair_hash(contexts, words), counts)
            contexts, words = contexts[at], words[at]
            shard = _bigram_shard(contexts, keys, heavy, shards)
            again, counts = _bytewise(counts)
            contexts, words, shard = contexts[again], words[again], shard[again]
            order = np.lexsort((contexts, shard))
            contexts, words, counts, shard = contexts[order], words[order], counts[order], shard[order]
            out: dict[str, list] = {"shard": [], "contexts": [], "runs": [], "words": [], "counts": []}
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(edges[:-1], edges[1:]):
                part = contexts[a:b]
                begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                out["shard"].append(int(shard[a]))
                out["contexts"].append(part[begin].tobytes())
                out["runs"].append(np.diff(np.append(begin, len(part))).astype(np.uint32).tobytes())
                out["words"].append(words[a:b].tobytes())
                out["counts"].append(counts[a:b].tobytes())
            out["shard"] = pa.array(out["shard"], pa.int32())
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for _, _, tokens, contexts, _ in _token_chunks(batch.column("text")):
                _, at, counts = np.unique(pair_hash(contexts, tokens), return_index=True, return_counts=True)
                kept.append((contexts[at], tokens[at], counts))
                if sum(len(k[0]) for k in kept) > MERGE_ENTRIES:
                    yield emit()
        if kept:
            yield emit()

    return count


STATS = "own int, shard int, words binary, counts binary, heavy binary, entries long, n1 long, n2 long, n3 long, n4 long"


def _store_bigrams(folder: str, shards: int, heavy: np.ndarray):
    """Store a shard's bigrams and contexts; returns its words' continuation counts by word shard."""

    def store(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        contexts = np.repeat(joined(group["contexts"].to_pylist(), np.uint64), joined(group["runs"].to_pylist(), np.uint32))
        words = joined(group["words"].to_pylist(), np.uint64)
        keys, at, counts = _added(pair_hash(contexts, words), joined(group["counts"].to_pylist(), np.uint8))
        contexts, words = contexts[at], words[at]
        big = counts >= 255
        save_array(folder, f"bigram-{shard}", keys)
        save_array(folder, f"count-{shard}", np.minimum(counts, 255).astype(np.uint8))
        save_array(folder, f"big-{shard}", keys[big])
        save_array(folder, f"bigcount-{shard}", counts[big])

        order = np.argsort(contexts)
        ordered, c = contexts[order], counts[order]
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.stack([np.add.reduceat((c == 1).astype(np.int64), edges), np.add.reduceat((c == 2).astype(np.int64), edges), np.add.reduceat((c > 2).astype(np.int64), edges)], 1)
        distinct = ordered[edges]
        is_heavy = np.isin(distinct, heavy)
        save_array(folder, f"context-{shard}", distinct[~is_heavy])
        save_array(folder, f"backoff-{shard}", sums[~is_heavy].astype(np.uint32))
        heavy_sums = np.concatenate([distinct[is_heavy].view(np.int64)[:, None], sums[is_heavy]], 1)

        after, n = np.unique(words, return_counts=True)
        rows = [(s, *c) for s, c in deal(shard_of(after, shards), after, n.astype(np.uint32))]
        first = np.arange(len(rows)) == 0
        totals = [len(counts)] + [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table(
            {
                "own": pa.array([shard] * len(rows), pa.int32()),
                "shard": pa.array([r[0] for r in rows], pa.int32()),
                "words": pa.array([r[1] for r in rows], pa.binary()),
                "counts": pa.array([r[2] for r in rows], pa.binary()),
                "heavy": pa.array([heavy_sums.tobytes() if f else b"" for f in first], pa.binary()),
                **{
                    name: pa.array([total if f else 0 for f in first], pa.int64())
                    for name, total in zip(("entries", "n1", "n2", "n3", "n4"), totals, strict=True)
                },
            }
        )

    return store


def _store_words(folder: str):
    """Store a shard's words with their counts and continuation counts."""

    def store(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        is_count = group["kind"].to_pylist()
        blobs = list(zip(is_count, group["words"].to_pylist(), group["counts"].to_pylist()))
        words = joined((w for k, w, _ in blobs if k == "count"), np.uint64)
        counts = joined((c for k, _, c in blobs if k == "count"), np.int64)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        after, _, n = _added(
            joined((w for k, w, _ in blobs if k == "after"), np.uint64),
            joined((c for k, _, c in blobs if k == "after"), np.uint32),
        )
        continued = np.zeros(len(words), np.int64)
        continued[np.searchsorted(words, after)] = n
        save_array(folder, f"word-{shard}", words)
        save_array(folder, f"wordcount-{shard}", counts)
        save_array(folder, f"continued-{shard}", continued)
        return pa.table(
            {f"n{k}": pa.array([int((continued == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}
            | {"more": pa.array([int((continued > 2).sum())], pa.int64())}
        )

    return store


@dataclass
class Model:
    """Where the arrays are, and the few numbers that scoring needs besides."""

    folder: str
    word_shards: int
    shards: int
    tokens: int
    types: int
    texts: int
    bigrams: int
    heavy: np.ndarray
    heavy_sums: np.ndarray
    discounts: Discounts
    lower: Discounts
    lower_n: tuple[int, int, int]
    filled: frozenset[tuple[bool, int]]
    _open: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def array(self, name: str, dtype: type) -> np.ndarray:
        if name not in self._open:
            self._open[name] = map_array(self.folder, name, dtype)
        return self._open[name]

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _look_up(self, shard: np.ndarray, keys: np.ndarray, table: str):
        """For sorted runs of one shard: ``(places in keys, places in the shard's table, shard)``."""
        for s in np.unique(shard):
            stored = self.array(f"{table}-{s}", np.uint64) if (table[0] == "w", int(s)) in self.filled else ()
            if not len(stored):
                continue
            mine = np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
            hit = stored[at] == keys[mine]
            yield mine[hit], at[hit], s

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and continuation counts of sorted words."""
        counts, continued = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for mine, at, s in self._look_up(shard_of(words, self.word_shards), words, "word"):
            counts[mine] = self.array(f"wordcount-{s}", np.int64)[at]
            continued[mine] = self.array(f"continued-{s}", np.int64)[at]
        return counts, continued

    def back_off(self, contexts: np.ndarray) -> np.ndarray:
        """The discount mass of sorted contexts: what their bigrams gave up, in counts."""
        sums = np.zeros((len(contexts), 3), np.int64)
        for mine, at, s in self._look_up(shard_of(contexts, self.shards), contexts, "context"):
            sums[mine] = self.array(f"backoff-{s}", np.uint32).reshape(-1, 3)[at]
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, contexts), len(self.heavy) - 1)
            hit = self.heavy[at] == contexts
            sums[hit] = self.heavy_sums[at[hit]]
        return sums @ np.array([self.discounts.once, self.discounts.twice, self.discounts.more])

    def bigrams_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys, at, back = np.unique(pair_hash(contexts, words), return_index=True, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        shard = _bigram_shard(contexts[at], keys, self.heavy, self.shards)
        for mine, place, s in self._look_up(shard, keys, "bigram"):
            counts[mine] = self.array(f"count-{s}", np.uint8)[place]
        big = np.flatnonzero(counts == 255)
        if len(big):
            for mine, place, s in self._look_up(shard[big], keys[big], "big"):
                counts[big[mine]] = self.array(f"bigcount-{s}", np.int64)[place]
        return counts[back]

    def log10(self, tokens: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each token after its context, and the token's training count."""
        if not self.tokens:
            return np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        distinct, back = np.unique(np.concatenate([tokens, contexts]), return_inverse=True)
        counts, continued = self.words(distinct)
        mass = self.back_off(distinct)
        seen = np.where(distinct == BEGIN, self.texts, counts)
        token, context = back[: len(tokens)], back[len(tokens) :]
        spare = np.dot(self.lower_n, [self.lower.once, self.lower.twice, self.lower.more]) / self.bigrams
        lower = np.maximum(continued - self.lower.of_counts(continued), 0) / self.bigrams + spare / (self.types + 1)
        pairs = self.bigrams_of(contexts, tokens)
        total = np.maximum(seen[context], 1)
        upper = np.maximum(pairs - self.discounts.of_counts(pairs), 0) / total
        weight = np.where(seen[context] > 0, mass[context] / total, 1.0)
        return np.log10(upper + weight * lower[token]), counts[token]


def fit(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` and store the model in the shared folder."""
    require(docs, "text")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select("text")
    folder = scratch(spark, "model")
    word_shards = max(MIN_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blobs = "shard int, words binary, counts binary"
    words = written(
        texts.mapInArrow(_count_words(word_shards), blobs)
        .groupBy("shard")
        .applyInArrow(_add_words, f"{blobs}, tokens long, types long"),
        "words",
    )
    n = words.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()[0]
    tokens, types = n["tokens"] or 0, n["types"] or 0
    shards = max(MIN_SHARDS, math.ceil(tokens / SHARD_TOKENS))
    # At most 2 * shards contexts can be that frequent; BEGIN is counted like one of them.
    frequent = words.select("words", "counts").mapInArrow(_heavy(shards, tokens / (2 * shards)), "word long")
    heavy = np.array([r["word"] for r in frequent.collect()], np.int64).view(np.uint64)
    heavy = np.unique(np.append(heavy[heavy != END], BEGIN))

    pairs = texts.mapInArrow(
        _count_bigrams(shards, heavy), "shard int, contexts binary, runs binary, words binary, counts binary"
    )
    stored = written(pairs.groupBy("shard").applyInArrow(_store_bigrams(folder, word_shards, heavy), STATS), "bigrams")
    found = stored.agg(*[F.sum(c).alias(c) for c in ("entries", "n1", "n2", "n3", "n4")]).collect()[0]
    sums = np.zeros((len(heavy), 3), np.int64)
    for row in stored.where(F.length("heavy") > 0).select("heavy").collect():  # a row per shard
        part = np.frombuffer(row["heavy"], np.int64).reshape(-1, 4)
        sums[np.searchsorted(heavy, part[:, 0].copy().view(np.uint64))] += part[:, 1:]

    after = stored.select(F.lit("after").alias("kind"), "shard", "words", "counts")
    both = words.select(F.lit("count").alias("kind"), "shard", "words", "counts").unionByName(after)
    lower = both.groupBy("shard").applyInArrow(_store_words(folder), "n1 long, n2 long, n3 long, n4 long, more long")
    low = lower.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more")]).collect()[0]
    ends = texts.count()
    return Model(
        folder,
        word_shards,
        shards,
        tokens,
        types,
        ends,
        max(1, found["entries"] or 0),
        heavy,
        sums,
        Discounts.of([found[f"n{k}"] or 0 for k in (1, 2, 3, 4)]),
        Discounts.of([low[f"n{k}"] or 0 for k in (1, 2, 3, 4)]),
        (low["n1"] or 0, low["n2"] or 0, low["more"] or 0),
        frozenset(
            [(True, r[0]) for r in words.select("shard").collect()]
            + [(False, r[0]) for r in stored.select("own").distinct().collect()]
        ),
    )


RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` but the text, with token counts, the unigram base score, the model's log10
    probability of the text and its perplexity."""
    require(docs, "text")
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in RESULT]
    shared = ship(docs.sparkSession, model)
    given = docs.select(*kept)
    carried = [f for f in given.schema.fields if f.name != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: Model = shipped(shared)
        for batch in batches:
            n = batch.num_rows
            counts, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, full = np.zeros(n), np.zeros(n)
            for first, last, tokens, contexts, starts in _token_chunks(batch.column("text")):
                logs, seen = lm.log10(tokens, contexts)
                counts[first:last] = np.diff(np.append(starts, len(tokens)))
                known[first:last] = np.add.reduceat((seen > 0).astype(np.int64), starts)
                full[first:last] = np.add.reduceat(logs, starts)
                flat = np.log10((seen + 0.5) / (lm.tokens + 0.5 * (lm.types + 1)))
                base[first:last] = np.add.reduceat(flat, starts)
            columns = [batch.column(f.name) for f in carried]
            columns += [pa.array(counts), pa.array(known), pa.array(np.full(n, lm.tokens, np.int64)), pa.array(base), pa.array(full)]
            columns.append(pa.array(10.0 ** np.minimum(-full / np.maximum(counts, 1), 300.0)))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in carried] + list(RESULT))

    kinds = (LongType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType())
    result = StructType(carried + [StructField(name, kind) for name, kind in zip(RESULT, kinds)])
    return given.mapInArrow(scored, result)
