"""Benchmark decontamination by winnowing.

Words of documents and benchmark items are hashed in k-grams; of every ``w`` consecutive k-grams the
smallest hash is kept. Two texts that share a span of ``k + w - 1`` words therefore keep a k-gram of
that span in common, so with ``k + w - 1`` equal to the window no shared window is missed. Documents
with a fingerprint in common are looked at again: only the windows around each hit are formed, and
they are joined with the item windows as text, so a hash collision never marks a word.

Documents are told apart by a digest of their text: copies are examined once, and neither a null nor
a repeated ``doc_id`` mixes two texts. A null or empty text has no words and is clean; an item
without words is never found; an item with fewer words than a window is one window, found by its own
length; items with a null id mark words but are not counted. Columns of ``docs`` that have the name
of a result column are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.shared import let, lower_ascii, require, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 5
BROADCAST_FINGERPRINTS = 200_000
PLACE_BITS = 28  # words of a text, up to the longest string there can be
PLACE_MASK = (1 << PLACE_BITS) - 1


def content_words(text: Column) -> Column:
    """Lower-cased words of letters and digits; every character beyond ASCII belongs to a word."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def winnow(words: Column, k: int, w: int) -> Column:
    """The smallest k-gram of every ``w`` neighbours, once each, as longs.

    The low ``PLACE_BITS`` bits hold the 0-based position of the k-gram, the others its hash: one
    minimum gives both, and of equal hashes the first counts. The hash is short, which can only add
    places to look at. A text with fewer than ``w`` k-grams keeps its smallest one.
    """
    none = F.array().cast("array<bigint>")

    def gram(hashed: Column, i: Column) -> Column:
        place = (i - 1).cast("bigint")
        return F.xxhash64(F.slice(hashed, i, k), F.lit(k)).bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(place)

    def grams(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (k - 1)), lambda i: gram(hashed, i))

    def smallest(g: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(g) - (w - 1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(g, i, w))))

    def of(hashed: Column) -> Column:
        picked = grams(hashed) if w == 1 else let(grams(hashed), smallest)
        return F.when(F.size(hashed) < k, none).otherwise(picked)

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def _print_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(~PLACE_MASK))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(span, n_span, item_id)``: each distinct window of each item as text."""
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), content_words(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    spans = F.transform(
        F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.array_join(F.slice("words", i, length), " ")
    )
    return words.select("item_id", length.alias("n_span"), F.explode(spans).alias("span")).distinct()


def _fingerprints(windows: DataFrame, window: int, k: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Fingerprints a document must share, and how to look for them: ``(k, w, n)``.

    Items of fewer words than the window have spans too short to be winnowed by the same rule; each
    such length ``n`` that occurs is looked for by the hash of all its words.
    """
    short = sorted(r[0] for r in windows.where(F.col("n_span") < window).select("n_span").distinct().collect())
    ways = [(k, window - k + 1, window)] + [(n, 1, n) for n in short]
    found = None
    for size, of, n in ways:
        packed = F.explode(winnow(F.split("span", " "), size, of)).alias("packed")
        part = windows.where(F.col("n_span") == n).select(packed)
        part = part.select(_print_of(F.col("packed")).alias("fp"), F.lit(n).alias("n"))
        found = part if found is None else found.unionByName(part)
    return found.distinct(), ways


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings) and ``contaminated``."""
    require(docs, "text")
    require(benchmark, "item_id", "text")
    if not 1 <= k <= window:
        raise ValueError(f"k must be between 1 and {window}")
    windows = written(item_windows(benchmark, window), "item-windows")
    fingerprints, ways = _fingerprints(windows, window, k)
    fingerprints = written(fingerprints, "fingerprints")
    if fingerprints.count() <= BROADCAST_FINGERPRINTS:
        fingerprints = F.broadcast(fingerprints)  # twelve bytes a row; larger sets are shuffled

    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest")
    prints = None
    for size, of, n in ways:
        packed = docs.select(digest, F.explode(winnow(content_words(F.col("text")), size, of)).alias("packed"))
        part = packed.select(
            "digest",
            _print_of(F.col("packed")).alias("fp"),
            F.col("packed").bitwiseAND(F.lit(PLACE_MASK)).cast("int").alias("at"),
            F.lit(size).alias("k"),
            F.lit(n).alias("n"),
        )
        prints = part if prints is None else prints.unionByName(part)
    hits = prints.join(fingerprints, ["fp", "n"], "left_semi")
    # A window of n words that covers the k-gram at ``at`` starts at most n - k words before it.
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("n") + F.col("k")), F.col("at")))
    starts = hits.select("digest", "n", near.alias("start")).distinct()
    starts = starts.groupBy("digest").agg(F.collect_list(F.struct("start", "n")).alias("starts"))

    texts = docs.select(digest, "text").join(starts, "digest")
    words = content_words(F.col("text"))
    spans = let(
        words,
        lambda w: F.transform(
            F.filter(F.col("starts"), lambda s: s["start"] + s["n"] <= F.size(w)),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["n"].alias("n"),
                F.array_join(F.slice(w, s["start"] + 1, s["n"]), " ").alias("span"),
            ),
        ),
    )
    candidates = texts.select("digest", F.inline(spans)).distinct()
    by_span = windows.groupBy("span", F.col("n_span").alias("n")).agg(
        F.collect_set("item_id").alias("items")
    )
    matched = candidates.join(by_span, ["span", "n"])

    def covered(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

        def step(a: Column, s: Column) -> Column:
            end = F.greatest(a["end"], s["start"] + s["n"])
            return F.struct(
                end.alias("end"), (a["hit"] + end - F.greatest(a["end"], s["start"])).cast("long").alias("hit")
            )

        return F.aggregate(F.array_sort(spans), start, step, lambda a: a["hit"])

    matched = matched.select("digest", "start", "n", "items")
    hit_words = matched.groupBy("digest").agg(
        covered(F.collect_set(F.struct("start", "n"))).alias("n_hit")
    )
    hit_items = (
        matched.select("digest", F.explode("items").alias("item"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    found = hit_words.join(hit_items, "digest", "left").withColumnRenamed("digest", "_digest")
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "item_ids", "contaminated")]
    return (
        docs.select(*kept, digest.alias("_key"), F.size(content_words(F.col("text"))).cast("long").alias("n_words"))
        .join(found, F.col("_key") == F.col("_digest"), "left")
        .select(
            *kept,
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )
