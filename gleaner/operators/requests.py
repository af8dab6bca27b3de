"""Request tables: defaults, bounds, filters, and bounded batches.

Searches answer a table of requests at once. What depends on the requests alone (terms, vectors,
limits) is small by contract, so a batch of at most ``MAX_BATCH`` rows is read into the plan and
turns into literal filters and broadcast sides of known size. A larger table is cut into slices
by a hash of the request id, and every slice's result is appended to a table in the shared folder:
the driver holds one slice at a time, whatever the number of requests.

A slice is a pass over what is searched. Searches that look at a row once for all requests take
slices that are as large as their results and vectors allow: ``PASS_REQUESTS`` requests, ``PASS_ROWS`` rows
of results, ``PASS_VALUES`` numbers in vectors. 20,000 requests with the default limit are two passes.

Every search begins with ``in_batches``, which refuses requests out of bounds before anything runs.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.schemas import (
    DEFAULT_FTS_WEIGHT,
    DEFAULT_LIMIT,
    DEFAULT_SEMANTIC_WEIGHT,
    MAX_DISTANCE,
    MAX_LIMIT,
    REQUEST_SCHEMA,
)
from gleaner.session import shared_folder

MAX_BATCH = 1000
PASS_REQUESTS = 20_000
PASS_ROWS = 200_000
PASS_VALUES = 1 << 23

_NAMED_FAULTS = 10  # requests an error names

_DEFAULTS = {
    "limit": DEFAULT_LIMIT,
    "include_distances": True,
    "fts_weight": DEFAULT_FTS_WEIGHT,
    "semantic_weight": DEFAULT_SEMANTIC_WEIGHT,
    "normalize_scores": True,
}


def local_frame(spark: SparkSession, rows: Iterable[Mapping], schema) -> DataFrame:
    """Driver rows as a local relation, which the optimizer can see through."""
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(row) for row in rows], schema=to_arrow_schema(schema)),
        schema=schema,
    )


def request_frame(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Requests from plain mappings; what a mapping leaves out gets its default."""
    return with_defaults(local_frame(spark, rows, REQUEST_SCHEMA))


def with_defaults(requests: DataFrame) -> DataFrame:
    """Add absent columns and replace nulls by the defaults."""

    def value(field) -> Column:
        given = F.col(field.name) if field.name in requests.columns else F.lit(None)
        given = given.cast(field.dataType)
        if field.name in _DEFAULTS:
            given = F.coalesce(given, F.lit(_DEFAULTS[field.name]).cast(field.dataType))
        return given.alias(field.name)

    return requests.select(*[value(field) for field in REQUEST_SCHEMA])


def complement_weights(requests: DataFrame) -> DataFrame:
    """One-knob form: a request with only a keyword weight gets ``1 - weight`` for the other side."""
    return requests.withColumn(
        "semantic_weight", F.coalesce("semantic_weight", F.lit(1.0) - F.col("fts_weight"))
    )


def clamp_limit(requests: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    clamped = F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce("limit", F.lit(DEFAULT_LIMIT))))
    return requests.withColumn("limit", clamped.cast("int"))


def is_blank(text: Column) -> Column:
    """Nothing but white space, or nothing."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


_LIMITS = (
    ("limit", 1, MAX_LIMIT),
    ("min_score", 0, None),
    ("max_distance", 0, MAX_DISTANCE),
    ("fts_weight", 0, 1),
    ("semantic_weight", 0, 1),
)
_NO_WEIGHT = "combined weights must be greater than 0"


def _bounds(hybrid: bool) -> dict[str, Column]:
    """Broken bounds by the reason that names them."""

    def outside(name: str, low: float, high: float | None) -> Column:
        value = F.col(name)
        broken = (value < low) | (value > high) if high is not None else value < low
        return F.coalesce(broken, F.lit(False))

    checks = {f"{name} out of bounds": outside(name, low, high) for name, low, high in _LIMITS}
    if hybrid:
        checks[_NO_WEIGHT] = F.col("fts_weight") + F.col("semantic_weight") <= 0
    return checks


def split_requests(
    requests: DataFrame, *, hybrid: bool = False, needs_vector: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Requests within bounds, and the others with a ``reason`` naming every broken bound."""
    checks = {"blank query": is_blank(F.col("query"))} | _bounds(hybrid)
    if needs_vector:
        checks["no query vector"] = F.col("query_vec").isNull()
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))
    judged = requests.withColumn("reason", F.concat_ws("; ", reasons))
    return (
        judged.where("reason = ''").drop("reason"),
        judged.where("reason <> ''"),
    )


def refuse_faulty(requests: DataFrame, *, hybrid: bool = False) -> None:
    """Raise if a request breaks a bound, or if its id is missing or not its own."""
    checks = {"no request id": F.col("request_id").isNull()} | _bounds(hybrid)
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))
    judged = requests.select("request_id", F.concat_ws("; ", reasons).alias("reason"))
    shared = requests.groupBy("request_id").count().where("count > 1 AND request_id IS NOT NULL")
    faults = judged.where("reason <> ''").unionByName(
        shared.select("request_id", F.lit("request id not unique").alias("reason"))
    )
    _raise_for((row["request_id"], row["reason"]) for row in faults.limit(_NAMED_FAULTS).collect())


def refuse_faulty_rows(rows: Iterable[Row], *, hybrid: bool = False) -> None:
    """``refuse_faulty`` for requests that the driver holds: no job."""

    def outside(row: Row, name: str, low: float, high: float | None) -> bool:
        value = row[name]
        # NaN is larger than any number, as it is for Spark
        return value is not None and (value < low or (high is not None and not value <= high))

    faults = []
    rows = list(rows)
    for row in rows:
        reasons = [] if row["request_id"] is not None else ["no request id"]
        reasons += [f"{name} out of bounds" for name, low, high in _LIMITS if outside(row, name, low, high)]
        if hybrid and None not in (row["fts_weight"], row["semantic_weight"]):
            reasons += [_NO_WEIGHT] if row["fts_weight"] + row["semantic_weight"] <= 0 else []
        if reasons:
            faults.append((row["request_id"], "; ".join(reasons)))
    counts = Counter(row["request_id"] for row in rows if row["request_id"] is not None)
    faults += [(request, "request id not unique") for request, n in counts.items() if n > 1]
    _raise_for(faults[:_NAMED_FAULTS])


def _raise_for(faults: Iterable[tuple[str, str]]) -> None:
    found = sorted(f"{request}: {reason}" for request, reason in faults)
    if found:
        raise ValueError("; ".join(found))


def is_given(values: Column) -> Column:
    """An empty list means no filter, like a missing one."""
    return F.coalesce(F.size(values) > 0, F.lit(False))


def resolve_filters(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Add ``allowed_ciks``: null for no filter, empty when given tickers lead nowhere."""
    wanted = requests.select("request_id", F.explode("tickers").alias("ticker")).select(
        "request_id", F.upper("ticker").alias("ticker")
    )
    listed = companies.select(
        F.upper("ticker").alias("ticker"), F.col("cik").cast("string").alias("cik")
    )
    found = (
        wanted.join(listed, "ticker")
        .groupBy("request_id")
        .agg(F.collect_set("cik").alias("ticker_ciks"))
    )
    nothing = F.array().cast("array<string>")
    by_ticker = F.coalesce("ticker_ciks", nothing)
    allowed = (
        F.when(
            is_given(F.col("tickers")) & is_given(F.col("ciks")),
            F.array_intersect(by_ticker, F.col("ciks")),
        )
        .when(is_given(F.col("tickers")), by_ticker)
        .when(is_given(F.col("ciks")), F.col("ciks"))
    )
    return (
        requests.join(found, "request_id", "left")
        .withColumn("allowed_ciks", allowed)
        .drop("ticker_ciks")
    )


def passes_filter(allowed: Column, cik: Column) -> Column:
    return allowed.isNull() | F.coalesce(F.array_contains(allowed, cik), F.lit(False))


@dataclass(frozen=True)
class Batch:
    """At most ``MAX_BATCH`` resolved requests, both as rows and as a local relation."""

    rows: tuple[Row, ...]
    frame: DataFrame

    @property
    def filtered_ciks(self) -> list[str] | None:
        """Every cik some request accepts, or None as soon as one request accepts all."""
        if any(row["allowed_ciks"] is None for row in self.rows):
            return None
        return sorted({cik for row in self.rows for cik in row["allowed_ciks"] if cik is not None})

    def columns(self, cutoffs: list) -> tuple[list, list, list, list]:
        """Ids, limits, cutoffs and allowed ciks, as the task functions take them."""
        allowed = [None if r["allowed_ciks"] is None else frozenset(r["allowed_ciks"]) for r in self.rows]
        return [r["request_id"] for r in self.rows], [r["limit"] for r in self.rows], cutoffs, allowed

    def where(self, keep: Callable[[Row], bool]) -> "Batch":
        kept = tuple(row for row in self.rows if keep(row))
        return _batch(self.frame.sparkSession, kept, self.frame.schema)

    def empty(self, schema: str) -> DataFrame:
        return self.frame.sparkSession.createDataFrame([], schema)

    def map(self, change: Callable[[Row], Mapping]) -> "Batch":
        changed = tuple(Row(**{**row.asDict(), **change(row)}) for row in self.rows)
        return _batch(self.frame.sparkSession, changed, self.frame.schema)


def _batch(spark: SparkSession, rows: tuple[Row, ...], schema) -> Batch:
    return Batch(rows, local_frame(spark, (row.asDict() for row in rows), schema))


def resolved_batch(spark: SparkSession, rows: Iterable[Row], companies: DataFrame) -> Batch:
    """Resolve the filters of a bounded set of requests; the directory is read only for tickers."""
    rows = list(rows)
    schema = StructType([*REQUEST_SCHEMA, StructField("allowed_ciks", ArrayType(StringType()))])
    rows = tuple(Row(**{**row.asDict(), "allowed_ciks": row["ciks"] or None}) for row in rows)
    if any(row["tickers"] for row in rows):
        asked = local_frame(spark, (row.asDict() for row in rows), REQUEST_SCHEMA)
        rows = tuple(resolve_filters(asked, companies).collect())
    return _batch(spark, rows, schema)


def in_batches(
    requests: DataFrame,
    companies: DataFrame,
    search: Callable[[Batch], DataFrame],
    max_batch: int = MAX_BATCH,
    hybrid: bool = False,
    shared_pass: bool = False,
) -> DataFrame:
    """Run ``search`` over all requests, slice by slice when there are more than ``max_batch``.

    Faulty requests are refused first; with ``hybrid`` a sum of weights of 0 is a fault, too. With
    ``shared_pass`` slices are as large as a pass can serve.
    """
    spark = requests.sparkSession
    rows = requests.limit(max_batch + 1).collect()
    if len(rows) <= max_batch:
        refuse_faulty_rows(rows, hybrid=hybrid)
        return search(resolved_batch(spark, rows, companies))

    folder = f"{shared_folder(spark)}/gleaner/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    requests.write.parquet(f"{folder}/requests")
    requests = spark.read.parquet(f"{folder}/requests")
    refuse_faulty(requests, hybrid=hybrid)
    weight = _share_of_a_pass(max_batch) if shared_pass else F.lit(1.0 / max_batch)
    slices = _slice_count(requests, weight)
    # Written by slice, so that each slice is read from its own directory.
    cut = requests.withColumn("slice", _slice(slices)).repartition("slice")
    cut.write.partitionBy("slice").parquet(f"{folder}/slices")
    numbered = spark.read.schema(cut.schema).parquet(f"{folder}/slices")
    for n in range(slices):
        rows = numbered.where(F.col("slice") == n).drop("slice").collect()
        if not rows:
            continue
        found = search(resolved_batch(spark, rows, companies))
        found.write.mode("append").parquet(f"{folder}/hits")
    return spark.read.parquet(f"{folder}/hits")


def _share_of_a_pass(max_batch: int) -> Column:
    """What a request takes of the requests, result rows and vector values that a pass holds."""
    return F.greatest(
        F.lit(1.0 / max(max_batch, PASS_REQUESTS)),
        F.col("limit") / F.lit(float(PASS_ROWS)),
        F.coalesce(F.size("query_vec"), F.lit(0)) / F.lit(float(PASS_VALUES)),
    )


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("request_id"), F.lit(slices))


def _slice_count(requests: DataFrame, weight: Column) -> int:
    """A slice count for which the weights of no slice exceed 1, checked by adding up.

    Ids are unique here, so slices shrink with their number. The first count leaves a slice about a
    tenth empty.
    """
    slices = max(2, math.ceil(1.1 * requests.agg(F.sum(weight)).first()[0]))
    while True:
        totals = requests.groupBy(_slice(slices).alias("s")).agg(F.sum(weight).alias("t"), F.count(F.lit(1)).alias("n"))
        # a request that takes more than a pass has one to itself
        largest = totals.where("n > 1").agg(F.max("t")).first()[0] or 0.0
        if largest <= 1.0 + 1e-9:
            return slices
        slices = math.ceil(slices * max(1.05, largest))
