from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gleaner.functions.stem import stem_word
from gleaner.functions.text import contains_ci, plain_list, tokens, upper_list
from gleaner.plans.store import Analyzer, forward_rows, posting_rows, term_stats


def _one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("x")).first()["x"]


def test_tokens_fold_and_split(spark):
    found = _one(spark, tokens(F.col("t")), t="Crème BRÛLÉE, naïve été Straße x2y  ñ")
    assert found == ["creme", "brulee", "naive", "ete", "stra", "e", "x", "y", "n"]


def test_tokens_of_text_without_letters(spark):
    assert _one(spark, tokens(F.col("t")), t=" 12 -- 3,4 ") == []


def test_lists(spark):
    assert _one(spark, plain_list(F.col("t")), t=" a ,, b,c  ,") == ["a", "b", "c"]
    assert _one(spark, upper_list(F.col("t")), t=" a ,, b,c  ,") == ["A", "B", "C"]


@pytest.mark.parametrize(
    ("needle", "found"),
    [("100%", True), ("C_n", True), ("x\\", False), ("\\", True), ("a%\\", True), ("", True), ("q", False)],
)
def test_contains_keeps_wildcards_and_takes_backslashes(spark, needle, found):
    assert _one(spark, contains_ci(F.col("t"), needle), t="a 100 % \\ can") is found


def test_wildcard_positions(spark):
    assert _one(spark, contains_ci(F.col("t"), "A_C"), t="xabcx") is True
    assert _one(spark, contains_ci(F.col("t"), "a%z"), t="abcxyz") is True
    assert _one(spark, contains_ci(F.col("t"), "a_z"), t="abcxyz") is False


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcdé -", max_size=60), min_size=1, max_size=20))
def test_term_counts_match_a_counter(spark, texts):
    rows = [(f"k{n}", "1", True, text) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "chunk_id string, cik string, linked boolean, chunk_text string")
    found = forward_rows(frame).collect()
    for row in found:
        text = texts[int(row["chunk_id"][1:])].replace("é", "e")
        expected = Counter(text.replace("-", " ").split())
        assert {t["term"]: t["tf"] for t in row["terms"]} == dict(expected)
        assert row["dl"] == sum(expected.values())


def test_term_statistics(spark):
    frame = spark.createDataFrame(
        [("a", "1", True, "x x y"), ("b", "1", False, "x"), ("c", "1", True, "!")],
        "chunk_id string, cik string, linked boolean, chunk_text string",
    )
    forward = forward_rows(frame)
    assert {tuple(r) for r in term_stats(forward).collect()} == {("x", 2, 3), ("y", 1, 1)}
    assert posting_rows(forward).count() == 3


# Words and stems printed in the publication.
PUBLISHED = {
    "caresses": "caress",
    "ponies": "poni",
    "cats": "cat",
    "feed": "feed",
    "agreed": "agre",
    "plastered": "plaster",
    "motoring": "motor",
    "sing": "sing",
    "conflated": "conflat",
    "hopping": "hop",
    "falling": "fall",
    "filing": "file",
    "happy": "happi",
    "sky": "sky",
    "relational": "relat",
    "digitizer": "digit",
    "decisiveness": "decis",
    "triplicate": "triplic",
    "electrical": "electr",
    "replacement": "replac",
    "adoption": "adopt",
    "effective": "effect",
    "probate": "probat",
    "rate": "rate",
    "cease": "ceas",
    "controll": "control",
    "roll": "roll",
}


@pytest.mark.parametrize(("word", "stem"), PUBLISHED.items())
def test_published_stems(word, stem):
    assert stem_word(word) == stem


def test_english_terms(spark):
    analyzer = Analyzer.english()
    assert _one(spark, analyzer.terms(F.col("t")), t="The companies don't report the REPORTED revenues") == [
        "compani",
        "report",
        "report",
        "revenu",
    ]
