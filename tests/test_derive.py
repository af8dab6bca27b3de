from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.operators.derive import chunk_rows, document_totals, first_chunk_id, section_rows, text_totals
from gleaner.plans import store as store_module
from gleaner.plans.store import shares, shuffle_partitions, split_vectors
from gleaner.schemas import EMBEDDINGS

TEXTS = [("a", "one\n\n  \ntwo\n"), ("b", "x" * 1700), ("c", ""), ("d", "é" * 801 + "\nend")]


def _documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id string, text string")


def test_sections(spark):
    rows = section_rows(_documents(spark)).where("doc_id = 'a'").orderBy("section_no").collect()
    assert [(r["section_id"], r["section_name"], r["section_text"]) for r in rows] == [
        ("a_1", "Risk Factors", "one"),
        ("a_4", "Business", "two"),
    ]


def test_chunks(spark):
    rows = chunk_rows(section_rows(_documents(spark))).collect()
    sizes = {r["chunk_id"]: (r["char_count"], len(r["chunk_text"])) for r in rows}
    assert sizes["b_1_0"] == (800, 800) and sizes["b_1_2"] == (100, 100)
    assert sizes["d_1_1"] == (1, 1) and sizes["d_2_0"] == (3, 3)
    assert not any(k.startswith("c") for k in sizes)


def test_totals_agree(spark):
    documents = _documents(spark)
    inside = documents.select("doc_id", text_totals(F.col("text")).alias("t")).select("doc_id", "t.*")
    grouped = document_totals(section_rows(documents))
    assert sorted(inside.where("total_sections > 0").collect()) == sorted(grouped.collect())


def test_first_chunk(spark):
    rows = _documents(spark).select("doc_id", first_chunk_id(F.col("doc_id"), F.col("text")).alias("k")).collect()
    assert dict(map(tuple, rows)) == {"a": "a_1_0", "b": "b_1_0", "c": None, "d": "d_1_0"}


def test_vectors_of_the_wrong_length_are_set_aside(tables):
    usable, rejected = split_vectors(tables[EMBEDDINGS], 2)
    assert [r["chunk_id"] for r in rejected.collect()] == ["c6"]
    assert {r["chunk_id"]: r["norm"] for r in usable.collect()}["c3"] == 2.0


def test_shuffle_partitions_are_restored(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), shuffle_partitions(spark, 77):
        assert spark.conf.get(name) == "77"
        raise RuntimeError
    assert spark.conf.get(name) == before


def test_directories_hold_whole_tasks(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "_PASSAGES_PER_FILE", 2)
    monkeypatch.setattr(store_module, "_MOST_DIRECTORIES", 2)
    opened = store_module.Store(spark, tables, str(tmp_path))
    rows = opened.passages().withColumn("file", F.col("_metadata.file_path"))
    assert opened.part_count() == 2
    assert rows.where(F.col("part") != opened.part_of(F.col("chunk_id"))).count() == 0
    assert 2 < rows.select("file").distinct().count() <= 6


def test_shares():
    assert shares(0, 100, 8) == 1
    assert shares(10_000, 100, 8) == 100
    assert shares(3_500, 1_000_000, 8) == 4
