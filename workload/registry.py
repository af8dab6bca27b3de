"""Names, Spark queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from gleaner.operators.requests import request_frame
from gleaner.plans.open import store_for
from gleaner.plans.store import Store
from gleaner.sources.raw import raw

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is settled so that both engines print the same values."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: settled_columns(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def settled_columns(frame: DataFrame) -> DataFrame:
    """Round doubles to six digits (no negative zero) and widen whole numbers."""

    def settle(field):
        column = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            column = column.cast("long")
        return column.alias(field.name)

    return frame.select(*[settle(field) for field in frame.schema])


def store(spark: SparkSession, sf_dir: str) -> Store:
    return store_for(spark, sf_dir)


def requests_for(spark: SparkSession, sf_dir: str, rows: list[dict]) -> DataFrame:
    """Request mappings to a request table; ``vec_id`` is replaced by that raw vector."""
    wanted = sorted({row["vec_id"] for row in rows if row.get("vec_id") is not None})
    vectors = _raw_vectors(spark, sf_dir, tuple(wanted)) if wanted else {}
    filled = [
        {**{k: v for k, v in row.items() if k != "vec_id"}, "query_vec": vectors.get(row.get("vec_id"))}
        for row in rows
    ]
    return request_frame(spark, filled)


@cache
def _raw_vectors(spark: SparkSession, sf_dir: str, ids: tuple[int, ...]) -> dict[int, list[float]]:
    found = raw(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids))
    return {row["vec_id"]: row["embedding"] for row in found.select("vec_id", "embedding").collect()}
