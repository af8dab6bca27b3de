"""Filings as JSON of several layouts in one folder, with a quarantine for what cannot be read.

A text is parsed once into a variant, whatever it holds; which layout it has is asked of the variant
afterwards, so one broken or foreign file costs its own row and no job. Layouts:

* items as fields of the object, ``section_<item>``: the form of ``filing_json``;
* an object under ``sections``, from item to text;
* a list under ``items`` of objects with ``item`` and ``text``.

A file of no bytes is no text for Spark and appears nowhere.

Cik and year come from the file's name, or from fields of these names where it does not tell them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.sources.filing_json import NAME_PATTERN

REJECTED_COLUMNS = ("filename", "file_path", "reason", "value")


def read_mixed_filings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Filings like those of ``read_filings``, and rejected files with a ``reason``; a file is a text."""
    files = spark.read.text(path, wholetext=True)
    named = files.select(
        F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_path").alias("file_path"), "value"
    )
    return split_layouts(named)


def read_mixed_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from lines, whose field ``filename`` names the original file."""
    lines = spark.read.text(path)
    name = F.try_variant_get(F.try_parse_json("value"), "$.filename", "string")
    return split_layouts(lines.select(name.alias("filename"), name.alias("file_path"), "value"))


def split_layouts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(filename, file_path, value)`` as filings and as rejected rows with a ``reason``."""
    parsed = texts.withColumn("v", F.try_parse_json("value"))
    in_name = lambda n: F.nullif(F.regexp_extract("filename", NAME_PATTERN, n), F.lit(""))
    told = parsed.select(
        F.coalesce(in_name(1), _told("cik")).alias("cik"),
        F.coalesce(in_name(2), _told("year")).try_cast("int").alias("year"),
        "filename",
        "file_path",
        _fields(F.col("v")).alias("fields"),
        "v",
        "value",
    )
    reason = (
        F.when(F.col("v").isNull(), F.lit("not JSON"))
        .when(~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)), F.lit("not an object"))
        .when(F.coalesce(F.size("fields"), F.lit(0)) == 0, F.lit("no sections"))
        .when(F.col("cik").isNull() | F.col("year").isNull(), F.lit("no cik or year"))
    )
    judged = told.withColumn("reason", reason)
    filings = judged.where("reason IS NULL").select("cik", "year", "filename", "file_path", "fields")
    return filings, judged.where("reason IS NOT NULL").select(*REJECTED_COLUMNS)


def _told(name: str) -> Column:
    """A field of the object as text."""
    return F.nullif(F.try_variant_get(F.col("v"), f"$.{name}", "string"), F.lit(""))


def _fields(v: Column) -> Column:
    """``section_<item>`` to text, from the first layout that gives any."""
    top = F.try_variant_get(v, "$", "map<string, variant>")
    own = F.map_filter(top, lambda key, _: F.startswith(key, F.lit("section_")))
    own = F.transform_values(own, lambda _, held: F.try_variant_get(held, "$", "string"))
    nested = F.try_variant_get(v, "$.sections", "map<string, string>")
    nested = F.transform_keys(nested, lambda key, _: F.concat(F.lit("section_"), key))
    listed = F.try_variant_get(v, "$.items", "array<struct<item: string, text: string>>")
    # of items that are named twice the first counts
    listed = F.filter(listed, lambda e: e["item"].isNotNull())
    first = F.filter(listed, lambda e, at: F.array_position(F.transform(listed, lambda o: o["item"]), e["item"]) == at + 1)
    listed = F.map_from_entries(F.transform(first, lambda e: F.struct(F.concat(F.lit("section_"), e["item"]), e["text"])))
    some = lambda fields: F.when(F.size(fields) > 0, fields)
    return F.coalesce(some(own), some(nested), some(listed))
