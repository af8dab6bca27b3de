"""Where results and tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.sources.tables import Tables


def response_json(envelopes: DataFrame) -> DataFrame:
    """Each response as one JSON text."""
    return envelopes.select("request_id", F.to_json(F.struct(*envelopes.columns)).alias("response"))


def write_responses(envelopes: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    envelopes.write.mode(mode).format(fmt).save(path)


def write_tables(tables: Tables, folder: str, mode: str = "overwrite") -> None:
    """Write logical tables as ``folder/<name>`` parquet, the form ``open_tables`` reads."""
    for name, frame in tables.items():
        frame.write.mode(mode).parquet(f"{folder}/{name}")
