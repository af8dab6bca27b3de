"""Things several operators of this package need: shared folders, written tables, let-binding."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.session import shared_folder

# White space that ends a word; fixed by the contracts of the registered queries.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, sizes are known.

    A lost executor costs a re-read of these files, never a re-run of what made them.
    """
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The optimizer may copy an expression into a lambda, where it would run per element; a lambda
    variable cannot be copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """An object of this package's classes for all tasks, without the package being there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(broadcast: Broadcast) -> object:
    """What ``ship`` sent: one object per worker, which keeps it for all its tasks."""
    if "shipped" not in broadcast.__dict__:
        broadcast.shipped = pickle.loads(broadcast.value)
    return broadcast.shipped


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of whole texts small, so that one batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def require(frame: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())
