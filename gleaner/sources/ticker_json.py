"""Company directories as published in JSON: an index-keyed map, and fields with data rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MAP_FORM = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
_TABLE_FORM = "struct<fields: array<string>, data: array<array<string>>>"


def _parsed(spark: SparkSession, path: str, form: str, whole_files: bool) -> DataFrame:
    """One JSON object per file, or per line."""
    objects = spark.read.text(path, wholetext=whole_files)
    return objects.select(F.from_json("value", form, {"mode": "FAILFAST"}).alias("parsed"))


def read_ticker_map(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """``{"0": {"cik_str": 1, "ticker": "A", "title": "B"}, ...}`` to the ticker table."""
    return (
        _parsed(spark, path, _MAP_FORM, whole_files)
        .select(F.explode("parsed").alias("key", "entry"))
        .select(
            F.col("key").cast("int").alias("index_key"),
            F.col("entry.cik_str").alias("cik"),
            "entry.ticker",
            "entry.title",
        )
    )


def read_exchange_table(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """``{"fields": ["cik", "name", ...], "data": [[1, "B", ...], ...]}`` to the company table."""

    def value(name: str) -> Column:
        return F.get("row", F.array_position("fields", F.lit(name)).cast("int") - 1)

    return (
        _parsed(spark, path, _TABLE_FORM, whole_files)
        .select(F.col("parsed.fields").alias("fields"), F.explode("parsed.data").alias("row"))
        .select(
            value("cik").cast("long").alias("cik"),
            value("name").alias("name"),
            value("ticker").alias("ticker"),
            value("exchange").alias("exchange"),
        )
    )
