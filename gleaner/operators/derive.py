"""Documents to sections to chunks, and document totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK_CHARS = 800
SECTION_NAMES = ("Business", "Risk Factors", "MD&A", "Financial Statements")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def section_rows(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to one row per non-blank line; numbering counts the blank ones."""
    number = F.col("pos") + 1
    names = F.array(*[F.lit(n) for n in SECTION_NAMES])
    return (
        documents.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "section_text"))
        .where(~_is_blank(F.col("section_text")))
        .select(
            F.concat("doc_id", F.lit("_"), number).alias("section_id"),
            "doc_id",
            number.alias("section_no"),
            F.get(names, F.pmod(number, F.lit(len(SECTION_NAMES)))).alias("section_name"),
            "section_text",
        )
    )


def chunk_rows(sections: DataFrame, width: int = CHUNK_CHARS) -> DataFrame:
    """Cut section texts into pieces of ``width`` characters, the last one shorter."""
    # One linear pass per text; repeated substring calls would rescan it for every piece.
    pieces = F.regexp_extract_all("section_text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return sections.select(
        "section_id", "doc_id", F.posexplode(pieces).alias("chunk_no", "chunk_text")
    ).select(
        F.concat("section_id", F.lit("_"), "chunk_no").alias("chunk_id"),
        "section_id",
        "doc_id",
        "chunk_text",
        F.length("chunk_text").alias("char_count"),
    )


def text_totals(text: Column) -> Column:
    """Section count and summed length of one document, worked out inside its row."""
    kept = F.filter(_lines(text), lambda line: ~_is_blank(line))
    return F.aggregate(
        kept,
        F.struct(
            F.lit(0).cast("long").alias("total_sections"),
            F.lit(0).cast("long").alias("total_chars"),
        ),
        lambda acc, line: F.struct(
            (acc["total_sections"] + 1).alias("total_sections"),
            (acc["total_chars"] + F.length(line)).alias("total_chars"),
        ),
    )


def first_chunk_id(doc_id: Column, text: Column) -> Column:
    """Key of a document's first chunk; null for a document without sections."""
    numbered = F.transform(_lines(text), lambda line, i: F.when(~_is_blank(line), i + 1))
    return F.concat(doc_id, F.lit("_"), F.get(F.array_compact(numbered), F.lit(0)), F.lit("_0"))


def document_totals(sections: DataFrame) -> DataFrame:
    """Section count and characters per document, from any sections table."""
    return sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_sections"),
        F.sum(F.length("section_text").cast("long")).alias("total_chars"),
    )
