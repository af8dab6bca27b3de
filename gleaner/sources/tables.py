"""The six logical tables a search runs over."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.schemas import EXPECTED_TABLES, TABLE_SCHEMAS

Tables = Mapping[str, DataFrame]


def open_tables(
    spark: SparkSession, folder: str, names: Iterable[str] = EXPECTED_TABLES
) -> dict[str, DataFrame]:
    """Open ``folder/<name>`` parquet tables with their declared schemas; absent ones are left out."""
    opened = {}
    for name in names:
        try:
            opened[name] = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return opened


def catalog_tables(
    spark: SparkSession, names: Iterable[str] = EXPECTED_TABLES
) -> dict[str, DataFrame]:
    """The expected tables and views the session catalog knows."""
    return {name: spark.table(name) for name in names if spark.catalog.tableExists(name)}


def register_views(tables: Tables) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def missing_tables(
    spark: SparkSession, expected: Iterable[str] = EXPECTED_TABLES
) -> DataFrame:
    """Expected names the session catalog does not list."""
    wanted = spark.createDataFrame([(name,) for name in expected], "table_name string")
    listed = spark.createDataFrame(
        [(table.name,) for table in spark.catalog.listTables()], "table_name string"
    )
    return wanted.join(listed, "table_name", "left_anti")


def _row_count(spark: SparkSession, tables: Tables, name: str) -> DataFrame:
    if name in tables:
        counted = tables[name].agg(F.count(F.lit(1)).alias("row_count"))
    else:
        counted = spark.range(1).select(F.lit(0).cast("long").alias("row_count"))
    return counted.select(
        F.lit(name).alias("table_name"), F.lit(name in tables).alias("present"), "row_count"
    )


def table_inventory(
    spark: SparkSession, tables: Tables, expected: Iterable[str] = EXPECTED_TABLES
) -> DataFrame:
    """One row per expected table: is it there, and how many rows; an absent one counts 0."""
    return reduce(DataFrame.unionByName, [_row_count(spark, tables, n) for n in expected])
