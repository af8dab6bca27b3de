"""Quality rules as a short-circuit cascade.

Every rule is a column that is true for a text to reject. Rules are timed on a sample, and run in the
order that rejects most per unit of cost; a text that one rule rejects is not shown to the next.
Which texts are kept does not depend on the order.

Defined results: a null text has no words and is rejected as too short; an empty table gives an
empty table; repeated rows are judged alike; extra columns pass through, and a column of the input
that has the name of a verdict column is replaced by it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.shared import SPACE, let, require

SYMBOLS = r"[#*$%&|<>]"
RUN = 5  # words in a window that counts as repeated


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters that markup and code use; all are ASCII, so bytes can be counted."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Most texts repeat none and stop after one hash set; the
    others sort their windows once, so the cost stays near linear in the length.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = F.filter(
                p,
                lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def covers(s: Column) -> Column:
            gaps = F.transform(s, lambda x, i: F.least(F.lit(RUN), F.coalesce(F.get(s, i + 1) - x, F.lit(RUN))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("long")

        return let(let(pairs, starts), covers)

    def count(bound: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(bound) - (RUN - 1)), lambda i: F.xxhash64(F.slice(bound, i, RUN))
        )
        hashed = let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
        return F.when(F.size(bound) <= RUN, F.lit(0).cast("long")).otherwise(hashed)

    return let(words, count)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the text and its words to a column that is true for a text to reject."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(words: Column, is_odd: Callable[[Column], Column], most: float) -> Column:
    return F.size(F.filter(words, is_odd)) > F.size(words) * F.lit(most)


def _stutters(words: Column) -> Column:
    return let(
        words,
        lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))) * 10
        > F.size(w) * 3,
    )


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda text, words: F.size(words) < 10),
    Rule("repeated_words", lambda text, words: repeated_words(words) * 100 > F.size(words) * 20),
    Rule("symbols", lambda text, words: symbol_count(text) * 10 > F.size(words)),
    Rule("repeated_lines", lambda text, words: duplicate_lines(text) * 2 > F.size(F.split(F.coalesce(text, F.lit("")), "\n"))),
    Rule("shouting", lambda text, words: _share(words, lambda w: w.rlike(r"^\p{Lu}[\p{Lu}\P{L}]*\p{Lu}[\P{L}]*$"), 0.3)),
    Rule("few_letters", lambda text, words: ~(F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) * 2 >= F.size(words))),
    Rule("stutter", lambda text, words: _stutters(words)),
    Rule("word_length", lambda text, words: (word_chars(words) < F.size(words) * 2) | (word_chars(words) > F.size(words) * 15)),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: int
    seen: int

    @property
    def worth(self) -> float:
        return (self.rejected / max(1, self.seen)) / max(self.seconds, 1e-6)


def measure(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000) -> list[Measured]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows, best worth first.

    The rows are drawn where they lie, by a share of their number. The sample only decides the
    order; it never decides which texts are kept.
    """
    texts = docs.select("text")
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = (texts.sample(share, seed=1) if share < 1 else texts).withColumn("words", words_of(F.col("text")))
    sample = sample.persist()
    try:
        seen = sample.count()
        found = []
        for rule in rules:
            rejected = F.coalesce(F.sum(rule.rejects(F.col("text"), F.col("words")).cast("long")), F.lit(0))
            counted = sample.agg(rejected.alias("n"))
            began = time.perf_counter()
            n = counted.collect()[0]["n"]
            found.append(Measured(rule.name, time.perf_counter() - began, n, seen))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda m: (-m.worth, m.seconds, m.name))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the rule that stopped the text, null if kept)."""
    require(docs, "text")
    by_name = {rule.name: rule for rule in rules}
    order = [by_name[m.name] for m in measure(docs, rules, sample_rows)]
    text = F.coalesce(F.col("text"), F.lit(""))

    def stopped(words: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in order:
            chain = chain.when(rule.rejects(text, words), F.lit(rule.name))
        return chain

    judged = docs.withColumn("rejected_by", let(words_of(F.col("text")), stopped))
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def text_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures of each text."""
    require(docs, "text")
    text = F.col("text")
    measures = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.withColumns(
        {"_m": measures, "n_symbols": symbol_count(text), "n_dup_lines": duplicate_lines(text)}
    ).withColumns({c: F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_m")
