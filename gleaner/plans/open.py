"""One store per session and source folder."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import SparkSession

from gleaner.plans.store import Store
from gleaner.session import shared_folder
from gleaner.sources.raw import logical_tables

_open: dict[tuple[str, str], Store] = {}
_lock = threading.Lock()


def work_folder(spark: SparkSession, source: str) -> str:
    """A folder in the shared area for what this application derives from ``source``."""
    key = hashlib.sha256(source.encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/gleaner/{spark.sparkContext.applicationId}/{key}"


def store_for(spark: SparkSession, sf_dir: str) -> Store:
    """The store over the raw tables in ``sf_dir``; its layouts are written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _open:
            _open[key] = Store(spark, logical_tables(spark, sf_dir), work_folder(spark, sf_dir))
        return _open[key]
