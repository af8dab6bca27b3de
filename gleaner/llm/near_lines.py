"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of lower-cased words. A line goes if an earlier line equals it, or differs from
it by one word inserted, deleted or replaced. "Earlier" is by document id (nulls last), then text
digest, then place in the text. Lines of fewer than ``min_words`` words are not compared by edits, as
one word is too much of them; they go as exact repeats only if ``exact_words`` allows it.

Every candidate line emits, for each of its words, the hash of the line with a hole in that word's
place and the hash of the line without that word. Lines with the same hole pattern differ by one
replaced word, so a group of them needs no pairs: all but its earliest go. A line without a word is
joined with the lines that are just that. What is found is verified by edit distance on the words.

Candidates are lines that share their first or their last half with another line; without that, two
lines cannot be one word apart.

With ``words_per_edit`` the bound grows: two lines may differ by one word for every so many words of
the shorter one. Lines long enough for two edits are then also cut into winnowed word n-grams.
Lines within the bound share a run of words long enough to hold a window, so they share an n-gram at
places no further apart than the bound; pairs that do are verified by edit distance on the words.
Each is first compared with the earliest line of its n-grams, and with all others only if that fails.
Two lines that share many n-grams meet at the first of them, and again only after a gap of several.

Defined results: null and empty texts have no lines; rows that agree in id and text are one document
and share one fate; an empty table gives an empty result. Columns of the input that have the name of
a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.bloom import bloom_of, may_hold_all
from gleaner.llm.near_sets import text_key
from gleaner.llm.shared import WORD, let, require, small_batches, written
from gleaner.llm.words import gram_hashes, mix64, powers, texts, word_chunks

MIN_WORDS = 8
BROADCAST_BYTES = 32_000_000
ROW_BYTES = 80  # of a document's entry, besides its line numbers
LOOK_BACK = 4  # shared n-grams before a place that tell whether two lines have met
PLACES = 3  # places of one mark; no further apart than the least bound of lines that are cut into n-grams, two
_HOLE = np.uint64(0xA0761D6478BD642F)

RESULT = ("n_lines", "n_exact", "n_near", "removed")


def line_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, line number, words, bounds)`` of runs of lines; line ``i`` has ``words[bounds[i]:bounds[i + 1]]``."""
    data, offsets = texts(column)
    inner = np.flatnonzero(data == 10) + 1
    inner = inner[~np.isin(inner, offsets)]
    # each line is a row of its own for the word hashing; the break stays with the line it ends
    cuts = np.union1d(inner, offsets)
    row = np.searchsorted(offsets, cuts[:-1], "right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    lines = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
    for first, last, words, bounds in word_chunks(lines):
        yield row[first:last], number[first:last], words, bounds


class Sequences:
    """Hashes of any run of words of a chunk, from prefix sums: the same run has the same hash anywhere."""

    def __init__(self, words: np.ndarray):
        self.power, self.inverse = powers(len(words) + 1)
        terms = words * self.power[: len(words)]
        self.before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.before[b] - self.before[a]) * self.inverse[a]


def digests_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digests of lines, as rows of two numbers; the halves come from unlike inputs."""
    a, b = bounds[:-1], bounds[1:]
    length = (b - a).astype(np.uint64)
    one, other = Sequences(words)(a, b), Sequences(mix64(words ^ _HOLE))(a, b)
    return np.stack([mix64(one + length), mix64(other ^ mix64(length))], 1)


def half_keys(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the first and the last half of lines, as they are and as ones grown by a word."""
    run, out = Sequences(words), []
    a, b = bounds[:-1], bounds[1:]
    for n in (b - a, b - a - 1):
        h = n // 2
        seed = (n * 4).astype(np.uint64)
        out.append(mix64(run(a, a + h) + mix64(seed + np.uint64(1))))
        out.append(mix64(run(b - (n - h), b) + mix64(seed + np.uint64(3))))
    return np.stack(out, 1).view(np.int64)


def _binary16(digests: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(digests).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, data]).cast(pa.binary())


def variants(words: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Hash of the line, hashes with a hole in each place, hashes without each word."""
    n = len(words)
    power, inverse = powers(n + 1)
    terms = words * power[:n]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    whole = before[-1:]
    own, shorter = mix64(np.array([n, n - 1], np.uint64))
    place = mix64(np.arange(n, dtype=np.uint64) * _HOLE + np.uint64(n))
    holes = mix64(whole - terms + place)
    without = before[:-1] + (whole - before[1:]) * inverse[1]
    return mix64(whole + own)[0], holes, mix64(without + shorter)


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences differ by at most one inserted, deleted or replaced word."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    if len(a) == len(b):
        return bool((a[head + 1 :] == b[head + 1 :]).all())
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return bool((long[head + 1 :] == short[head:]).all())


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two word sequences differ by at most ``most`` inserted, deleted or replaced words."""
    goal = len(b) - len(a)
    if abs(goal) > most:
        return False

    def slide(i: int, diagonal: int) -> int:
        n = min(len(a) - i, len(b) - i - diagonal)
        other = np.flatnonzero(a[i : i + n] != b[i + diagonal : i + diagonal + n])
        return i + (int(other[0]) if len(other) else n)

    # how far into ``a`` each diagonal reaches with so many edits
    far = {0: slide(0, 0)}
    for edits in range(1, most + 1):
        if far.get(goal) == len(a):
            return True
        before, far = far, {}
        for d in range(-edits, edits + 1):
            steps = [before[x] + step for x, step in ((d, 1), (d - 1, 0), (d + 1, 1)) if x in before]
            i = min(max(steps, default=-1), len(a), len(b) - d)
            if i >= max(0, -d):
                far[d] = slide(i, d)
    return far.get(goal) == len(a)


_SIGNS = ("s0", "s1", "s2", "s3")
_BACK = [f"b{k}" for k in range(1, LOOK_BACK + 1)]


def _edits(shorter, words_per_edit: int):
    """The bound of two lines, from the words of the shorter one."""
    return max(1, shorter // words_per_edit)


def fingerprints(words: np.ndarray, bounds: np.ndarray, words_per_edit: int) -> tuple[np.ndarray, ...]:
    """``(line, place, hash)`` of the winnowed n-grams of lines that are long enough for two edits.

    ``k`` edits in ``k * words_per_edit`` words or more leave a run of at least ``run`` words as it was.
    """
    run = 2 * (words_per_edit - 1) // 3
    gram = max(1, run // 2)
    hashes = gram_hashes(words, gram)
    size = np.diff(bounds)
    window = run - gram + 1
    if len(hashes) < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    line = np.repeat(np.arange(len(size)), size)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1) + np.arange(len(hashes) - window + 1)
    inside = (line[: len(least)] == line[run - 1 : run - 1 + len(least)]) & (size >= 2 * words_per_edit)[line[: len(least)]]
    at = np.unique(least[inside])
    return line[at], at - bounds[line[at]], hashes[at]


def _lines(keyed: DataFrame, least: int, min_words: int) -> DataFrame:
    """A row per line of ``least`` words: its document, number, size and digest, and half keys from ``min_words`` on."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, words, bounds in line_chunks(batch.column("text")):
                size = np.diff(bounds)
                long = np.flatnonzero(size >= least)
                if not len(long):
                    continue
                at = pa.array(row[long])
                near = size[long] >= min_words
                halves = half_keys(words, bounds)[long[near]]
                offsets = pa.array(np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        batch.column("key").take(at),
                        pa.array(number[long].astype(np.int32)),
                        pa.array(size[long].astype(np.int32)),
                        _binary16(digests_of(words, bounds)[long]),
                        pa.ListArray.from_arrays(offsets, pa.array(halves.ravel())),
                    ],
                    ["doc_id", "key", "line", "n", "digest", "halves"],
                )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(emit, f"doc_id {kind}, key binary, line int, n int, digest binary, halves array<long>")


def _words_of(keyed: DataFrame, needed: DataFrame, min_words: int) -> DataFrame:
    """``(digest, words)`` of at least the needed lines, made again from the texts."""
    shared = keyed.sparkSession.sparkContext.broadcast(bloom_of(needed, "digest"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, _, words, bounds in line_chunks(batch.column("text")):
                digests = digests_of(words, bounds)
                wanted = (np.diff(bounds) >= min_words) & may_hold_all(shared.value, digests)
                for i in np.flatnonzero(wanted).tolist():
                    digest = digests[i].tobytes()
                    if digest not in seen:
                        seen.add(digest)
                        found[digest] = words[bounds[i] : bounds[i + 1]].tobytes()
            if found:
                yield pa.RecordBatch.from_pydict({"digest": list(found), "words": list(found.values())})

    return keyed.select("text").mapInArrow(again, "digest binary, words binary")


def _emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [variants(np.frombuffer(w, np.uint64)) for w in batch.column("words").to_pylist()]
        if made:
            ords = np.repeat(batch.column("ord").to_numpy(), [len(holes) for _, holes, _ in made])
            holes, without = (np.concatenate([m[k] for m in made]).view(np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_pydict({"hole": holes, "without": without, "ord": ords})


def _emit_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [variants(np.frombuffer(w, np.uint64))[0] for w in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(whole, np.uint64).view(np.int64)), batch.column("ord")], ["whole", "shorter"]
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("words").to_pylist(), batch.column("other").to_pylist())
        good = [within_one(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("digest").filter(pa.array(good))], ["digest"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which words lines have, modulo 256, as bits of four numbers. An edit changes two bits at most."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, 256), np.uint8)
        for row, words in enumerate(batch.column("words").to_pylist()):
            bits[row, (np.frombuffer(words, np.uint64) & np.uint64(255)).astype(np.int64)] = 1
        signs = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("ord"), *(pa.array(signs[:, k].copy()) for k in range(4))],
            ["digest", "ord", "s0", "s1", "s2", "s3"],
        )


def _numbered(keyed: DataFrame, first: DataFrame, needed: DataFrame, min_words: int) -> DataFrame:
    """``(digest, words, ord)`` of the needed lines; ``ord`` grows with the order of the lines."""
    words = _words_of(keyed, needed, min_words)
    # sorted by range, numbered in place
    ready = words.join(needed, "digest", "left_semi").dropDuplicates(["digest"])
    ready = ready.join(first.select("digest", "first"), "digest").orderBy("first")
    return written(ready.select("digest", "words", F.monotonically_increasing_id().alias("ord")), "candidate-lines")


def near_digests(keyed: DataFrame, first: DataFrame, min_words: int) -> DataFrame:
    """Digests of lines that are one word away from an earlier line."""
    halves = first.select("digest", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    needed = written(halves.join(shared, "half", "left_semi").select("digest").distinct(), "candidates")
    lines = _numbered(keyed, first, needed, min_words)
    made = lines.select("ord", "words").mapInArrow(_emit_variants, "hole long, without long, ord long")
    groups = made.groupBy("hole").agg(F.min("ord").alias("earlier"), F.max("ord").alias("last"))
    groups = groups.where("earlier < last").select("hole", "earlier")
    replaced = made.join(groups, "hole").where("earlier < ord").select("ord", "earlier")
    whole = lines.select("ord", "words").mapInArrow(_emit_whole, "whole long, shorter long")
    grown = made.join(whole, made["without"] == whole["whole"]).where("ord <> shorter")
    grown = grown.select(F.greatest("ord", "shorter").alias("ord"), F.least("ord", "shorter").alias("earlier"))
    found = replaced.unionByName(grown).groupBy("ord").agg(F.min("earlier").alias("earlier"))
    other = lines.select(F.col("ord").alias("earlier"), F.col("words").alias("other"))
    pairs = found.join(lines, "ord").join(other, "earlier").select("digest", "words", "other")
    return pairs.mapInArrow(_verify, "digest binary")


def _looking_back(found: DataFrame) -> DataFrame:
    """Each n-gram of a line with marks of the ``LOOK_BACK`` ones before it and their places."""
    order = Window.partitionBy("digest").orderBy("at")
    marked = found.withColumn("mark", F.xxhash64("gram", F.floor(F.col("at") / PLACES)))
    none = lambda k: F.xxhash64("digest", F.lit(k))  # noqa: E731  at the start, what no other line has
    back = [F.coalesce(F.lag("mark", k).over(order), none(k)).alias(name) for k, name in enumerate(_BACK, 1)]
    return marked.select(*found.columns, *back)


def _meetings(later: DataFrame, found: DataFrame, words_per_edit: int) -> DataFrame:
    """Pairs of lines that share an n-gram and may be within the bound, few times each.

    A pair that has met at one of the n-grams just before does not meet again. What is left out has
    met at an earlier place of the later line, so the first meeting of each pair stays.
    """
    before = found.select(
        "gram", F.col("ord").alias("earlier"), *(F.col(c).alias(f"_{c}") for c in ("at", "n", *_SIGNS, *_BACK))
    )
    bound = F.floor(F.least("n", "_n") / F.lit(words_per_edit))
    # lines that share a passage, or copies with more edits, differ in too many words to be compared
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in _SIGNS), F.lit(0))
    may = (F.col("earlier") < F.col("ord")) & (F.abs(F.col("n") - F.col("_n")) <= bound)
    may &= (F.abs(F.col("at") - F.col("_at")) <= bound) & (differ <= bound * 2)
    for c in _BACK:
        may &= ~F.col(c).isin([F.col(f"_{b}") for b in _BACK])
    return later.join(before, "gram").where(may)  # in one condition, which keeps the order: what few pairs fail comes last


def further_digests(
    keyed: DataFrame, first: DataFrame, near: DataFrame, min_words: int, words_per_edit: int
) -> DataFrame:
    """Digests of lines not in ``near`` that are within the grown bound of an earlier line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, bounds in line_chunks(batch.column("text")):
                line, at, gram = fingerprints(words, bounds, words_per_edit)
                if len(line):
                    digests = _binary16(digests_of(words, bounds)[line])
                    size = np.diff(bounds)[line].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), digests, pa.array(at.astype(np.int32)), pa.array(size)],
                        ["gram", "digest", "at", "n"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(within(a, b, _edits(min(len(a), len(b)), words_per_edit)))
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(pa.array(good, pa.bool_()))], ["digest"])

    made = written(keyed.select("text").mapInArrow(emit, "gram long, digest binary, at int, n int"), "grams")
    mark = F.xxhash64("digest")
    shared = made.groupBy("gram").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a < b").select("gram")
    found = made.join(shared, "gram", "left_semi").dropDuplicates(["gram", "digest", "at"])
    found = written(found, "shared-grams")
    lines = _numbered(keyed, first, found.select("digest").distinct(), min_words)
    signed = lines.mapInArrow(_sign, "digest binary, ord long, s0 long, s1 long, s2 long, s3 long")
    found = written(_looking_back(found.join(signed, "digest")), "placed-grams")
    later = found.join(near.select("digest"), "digest", "left_anti")
    other = lines.select(F.col("ord").alias("earlier"), F.col("words").alias("other"))

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("ord", "earlier").distinct().join(lines, "ord").join(other, "earlier")
        return pairs.select("digest", "words", "other").mapInArrow(verify, "digest binary").distinct()

    leaders = found.groupBy("gram").agg(F.min("ord").alias("earlier"))
    one = written(judged(later.join(leaders, "gram").where("earlier < ord")), "further-lines")
    pairs = _meetings(later.join(one, "digest", "left_anti"), found, words_per_edit)
    return one.unionByName(judged(pairs))


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    measured: bool = False,
    words_per_edit: int | None = None,
    exact_words: int | None = None,
) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, ``n_lines``, ``n_exact``, ``n_near`` and ``removed``.

    ``removed`` holds the 0-based numbers of the lines that went, in order. ``measured`` adds three
    numbers, null where no line went: ``total_words`` before, ``copied_words`` in lines of any length
    that equal a line of an earlier document, and ``new_words`` in lines that stay and do not.
    Lines differ by one word at most, or with ``words_per_edit`` by one for every so many of their words.
    ``exact_words`` lets shorter lines than ``min_words`` go too, where they equal an earlier one.
    """
    require(docs, "doc_id", "text")
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    exact_words = min_words if exact_words is None else exact_words
    if not 1 <= exact_words <= min_words:
        raise ValueError("exact_words must be from 1 to min_words")
    if words_per_edit is not None and words_per_edit < 4:
        raise ValueError("words_per_edit must be at least 4")
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    lines = written(_lines(keyed, 1 if measured else exact_words, min_words), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "line")
    first = lines.groupBy("digest").agg(F.min(order).alias("first"), F.first("halves").alias("halves"))
    first = written(first, "first-lines")
    able = first.where(F.size("halves") > 0)
    near = written(near_digests(keyed, able, min_words).withColumn("near", F.lit(True)), "near-lines")
    if words_per_edit is not None:
        further = further_digests(keyed, able, near, min_words, words_per_edit)
        near = near.unionByName(written(further.withColumn("near", F.lit(True)), "further-near-lines"))
    verdict = first.select("digest", "first").join(near, "digest", "left")
    gone = lines.drop("halves").join(verdict, "digest").withColumn("near", F.coalesce("near", F.lit(False)))
    gone = gone.withColumn("exact", F.col("first") != order).where("near OR exact")
    goes = F.col("n") >= exact_words
    sums = []
    if measured:
        document = lambda of: F.struct(*[F.col(of + c) for c in ("doc_id", "key")])
        gone = gone.withColumn("copied", document("first.") != document(""))
        # by line number, as rows that agree in id and text bring their lines more than once
        sums = [
            F.aggregate(F.collect_set(F.when(which, F.struct("line", "n"))), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias(name)
            for name, which in (("copied_words", F.col("copied")), ("old_words", F.col("copied") | goes))
        ]
    gone = gone.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.when(goes, F.col("line")))).alias("removed"),
        F.size(F.collect_set(F.when(F.col("exact") & goes, F.col("line")))).cast("long").alias("n_exact"),
        *sums,
    )
    gone = gone.where(F.size("removed") > 0)
    gone = written(gone.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "gone")
    held = gone.agg(F.sum(F.size("removed") * 4 + ROW_BYTES)).collect()[0][0] or 0
    if held <= BROADCAST_BYTES:
        gone = F.broadcast(gone)  # then no text is shuffled; a larger table is joined by shuffle
    extra = ("total_words", "copied_words", "new_words") if measured else ()
    kept = [c for c in docs.columns if c not in (*RESULT, *extra)]
    named = docs.select(*kept, text_key(F.col("text")).alias("_own"))
    parts = F.split("text", "\n")
    rest = let(
        parts,
        lambda p: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("removed")), lambda i: F.get(p, i)
            ),
            "\n",
        ),
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest)
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(parts)).otherwise(0).cast("long")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    n_exact = F.coalesce("n_exact", F.lit(0).cast("long"))
    measures = []
    if measured:
        total = F.when(F.col("removed").isNotNull(), F.regexp_count("text", F.lit(WORD))).cast("long")
        measures = [total, F.col("copied_words"), total - F.col("old_words")]
    return (
        named.join(gone, named["doc_id"].eqNullSafe(gone["_id"]) & (named["_own"] == gone["_key"]), "left")
        .select(
            *[text.alias(c) if c == "text" else c for c in kept],
            n_lines.alias("n_lines"),
            n_exact.alias("n_exact"),
            (n_removed - n_exact).alias("n_near"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
            *[c.alias(name) for name, c in zip(extra, measures)],
        )
    )
