"""Results that readers see whole or not at all.

A version is written beside the others, checked, and named by a pointer that is replaced in one step.
A write that fails, or does not hold what was announced, leaves the version before it in place.
Versions that nobody needs any more are removed by a call of their own.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path; resolved as Spark resolves it."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def publish(frame: DataFrame, folder: str, rows: int | None = None, fmt: str = "parquet", least: int = 0) -> str:
    """Write a version of ``folder`` and make it the current one; its name.

    ``rows`` is the number of rows it must hold, ``least`` a lower bound. ValueError where it does not.
    """
    spark = frame.sparkSession
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    target = f"{folder}/versions/{version}"
    frame.write.format(fmt).save(target)
    held = spark.read.format(fmt).schema(frame.schema).load(target).count()
    if (rows is not None and held != rows) or held < least:
        raise ValueError(f"{target} holds {held} rows")
    _point(spark, folder, version)
    return version


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Write the pointer aside and rename it over the old one."""
    jvm = spark.sparkContext._jvm
    system, aside = _hadoop(spark, f"{folder}/.{POINTER}-{uuid.uuid4().hex}")
    stream = system.create(aside, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), options)


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The name of the version that readers see."""
    system, pointer = _hadoop(spark, f"{folder}/{POINTER}")
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_published(spark: SparkSession, folder: str, fmt: str = "parquet", version: str | None = None) -> DataFrame:
    """The current version, or a named one."""
    version = version or current_version(spark, folder)
    if version is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.format(fmt).load(f"{folder}/versions/{version}")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """All written versions, the newest first, also those that were never made current."""
    system, path = _hadoop(spark, f"{folder}/versions")
    if not system.exists(path):
        return []
    return sorted((entry.getPath().getName() for entry in system.listStatus(path)), reverse=True)


def roll_back(spark: SparkSession, folder: str, version: str) -> None:
    """Make an older version current again."""
    if version not in versions(spark, folder):
        raise ValueError(f"no version {version} in {folder}")
    _point(spark, folder, version)


def remove_old(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove versions other than the current one and the ``keep`` newest; their names."""
    current = current_version(spark, folder)
    gone = [name for name in versions(spark, folder)[keep:] if name != current]
    for name in gone:
        system, path = _hadoop(spark, f"{folder}/versions/{name}")
        system.delete(path, True)
    return gone
