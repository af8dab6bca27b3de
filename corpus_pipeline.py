"""Documents to a training mix: five stages, each written and read again by the next one's caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.decontaminate import contaminated
from gleaner.llm.mixing import mix
from gleaner.llm.near_lines import dedup_lines
from gleaner.llm.near_sets import one_of_each
from gleaner.llm.quality import cascade
from gleaner.llm.shared import WORD, written
from gleaner.llm.workload import table

WORDS_PER_EDIT = 25  # lines may differ by one word for each so many

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return cascade(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that is a copy, or nothing but repeated lines, goes.

    A copy lost lines, has at least half of its words in lines that equal lines of earlier documents,
    short lines too, and at most a tenth in lines that stay and equal none. What is left of it would
    be its short lines, which the next stage could not recognise. ``n_chars``, where there is one,
    follows the text.
    """
    found = dedup_lines(docs, measured=True, words_per_edit=WORDS_PER_EDIT)
    copy = (F.col("copied_words") * 2 >= F.col("total_words")) & (F.col("new_words") * 10 <= F.col("total_words"))
    found = found.where((F.size("removed") == 0) | (F.col("text").rlike(WORD) & ~copy))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8."""
    return one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

# Edit bounds, connected components and flows are not for SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, from the documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
