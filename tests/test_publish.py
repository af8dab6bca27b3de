"""Versions behind a pointer, and JSON of several layouts with a quarantine."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources.filing_json import filing_documents, filing_sections
from gleaner.sources.mixed_json import read_mixed_filings
from gleaner.sources.publish import current_version, publish, read_published, remove_old, roll_back, versions


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert current_version(spark, folder) is None and versions(spark, folder) == []
    with pytest.raises(ValueError, match="nothing is published"):
        read_published(spark, folder)
    first = publish(spark.range(3), folder)
    assert read_published(spark, folder).count() == 3
    second = publish(spark.range(5), folder, rows=5)
    assert current_version(spark, folder) == second
    assert read_published(spark, folder).count() == 5 and read_published(spark, folder, version=first).count() == 3
    with pytest.raises(ValueError, match="holds 2 rows"):
        publish(spark.range(2), folder, least=3)
    with pytest.raises(Exception, match="broken"):
        publish(spark.range(2).select(F.raise_error(F.lit("broken")).alias("x")), folder)
    assert current_version(spark, folder) == second and read_published(spark, folder).count() == 5
    roll_back(spark, folder, first)
    assert read_published(spark, folder).count() == 3
    with pytest.raises(ValueError, match="no version"):
        roll_back(spark, folder, "other")
    assert first not in remove_old(spark, folder, keep=0)
    assert versions(spark, folder) == [first] and read_published(spark, folder).count() == 3


FILES = {
    "1_2019.json": json.dumps({"section_7": "seven", "section_1a": "one", "section_9": None, "year": 1, "list": [1, {"a": 2}]}),
    "2_2018.json": json.dumps({"sections": {"1A": "risk", "7": "text"}, "items": "none"}),
    "3_2018.json": json.dumps({"items": [{"item": "7", "text": "a"}, {"item": "7", "text": "b"}, {"text": "no item"}, {"item": "1", "text": "c", "more": 1}]}),
    "named_inside.json": json.dumps({"cik": 12, "year": "2017", "sections": {"2": "x"}}),
    "4_2019.json": json.dumps({"items": [], "sections": {}}),
    "5_2019.json": '{"section_7": "cut o',
    "6_2019.json": " ",
    "7_2019.json": "[1, 2]",
    "8_2019.json": '"text"',
    "unnamed.json": json.dumps({"section_1": "x"}),
    "9_2019.json": json.dumps({"sections": "not an object"}),
}


def test_layouts(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    filings, rejected = read_mixed_filings(spark, str(tmp_path))
    found = {(r["doc_id"], r["section_name"]): r["section_text"] for r in filing_sections(filings).collect()}
    assert found == {
        ("1_2019", "Risk Factors"): "one",
        ("1_2019", "MD&A"): "seven",
        ("2_2018", "Risk Factors"): "risk",
        ("2_2018", "MD&A"): "text",
        ("3_2018", "Business"): "c",
        ("3_2018", "MD&A"): "a",
        ("12_2017", "Properties"): "x",
    }
    assert filing_documents(filings).count() == 4
    assert {r["filename"]: r["reason"] for r in rejected.collect()} == {
        "4_2019.json": "no sections",
        "5_2019.json": "not JSON",
        "6_2019.json": "not JSON",
        "7_2019.json": "not an object",
        "8_2019.json": "not an object",
        "9_2019.json": "no sections",
        "unnamed.json": "no cik or year",
    }
