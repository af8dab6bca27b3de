"""What a search writes and moves before it answers, as tables grow."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions.stem import stem_word, stemmed
from gleaner.operators import bm25, substring, summary
from gleaner.operators.requests import request_frame, resolved_batch
from gleaner.plans import store as layouts
from gleaner.plans.store import Store


def _batch(spark, store, rows):
    return resolved_batch(spark, request_frame(spark, rows).collect(), store.companies)


def _pairs(frame):
    return sorted((r["request_id"], r["rank"], r["chunk_id"]) for r in frame.collect())


@pytest.fixture
def many_tasks(spark):
    with layouts.setting(spark, "spark.sql.shuffle.partitions", "2"):
        yield


def test_texts_are_sorted_by_tasks_of_bounded_size(spark, tables, tmp_path, monkeypatch, many_tasks):
    monkeypatch.setattr(layouts, "_CHUNKS_PER_TASK", 1)
    opened = Store(spark, tables, str(tmp_path))
    rows = opened.passages().select("chunk_id", F.col("_metadata.file_path").alias("file")).collect()
    assert opened.part_count() == 1
    assert len({r["file"] for r in rows}) > 3 and len(rows) == opened.chunk_count()


def test_a_search_writes_no_index_of_its_own_accord(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "INDEX_FROM", 0)
    opened = Store(spark, tables, str(tmp_path), ranked=False)
    batch = _batch(spark, opened, [{"request_id": "r", "query": "appl"}, {"request_id": "no", "query": "none such"}])
    monkeypatch.setattr(substring, "candidate_blocks", _counted(calls := [], substring.candidate_blocks))
    read = _pairs(substring.substring_hits(batch, opened))
    assert read and not calls and not (tmp_path / "grams").exists()
    opened.write_grams()
    assert _pairs(substring.substring_hits(batch, opened)) == read
    assert len(calls) == 1


def _counted(calls, run):
    def counted(*given):
        calls.append(given)
        return run(*given)

    return counted


def test_a_search_writes_no_bounds_of_its_own_accord(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "WEIGH_FROM", 0)
    monkeypatch.setattr(bm25, "_worth_reading", _counted(calls := [], bm25._worth_reading))
    opened = Store(spark, tables, str(tmp_path))
    batch = _batch(spark, opened, [{"request_id": "r", "query": "apple cherry"}])
    read = _pairs(bm25.bm25_hits(batch, opened))
    assert read and not calls and not list(tmp_path.glob("peaks*"))
    bm25.write_peaks(opened)
    assert _pairs(bm25.bm25_hits(batch, opened)) == read
    assert len(calls) == 1


def test_terms_are_folded_on_their_way_to_a_bucket(spark):
    schema = "chunk_id string, cik string, dl int, terms array<struct<term:string,tf:int>>"
    rows = [("a", "1", 3, [("x", 2), ("yz", 1)]), ("b", None, 1, [("x", 1)]), ("c", "1", 0, []), ("a", "1", 1, [("w", 1)])]
    forward = spark.createDataFrame(rows, schema)
    folded = layouts.folded_terms(forward)
    assert dict(folded.dtypes)["names"] == "string"
    unfolded = layouts.posting_rows(layouts.unfolded_terms(folded))
    assert sorted(map(str, unfolded.collect())) == sorted(map(str, layouts.posting_rows(forward).collect()))
    assert unfolded.schema.simpleString() == layouts.posting_rows(forward).schema.simpleString()


def test_an_explained_response_searches_once(spark, store, monkeypatch):
    monkeypatch.setattr(summary, "hybrid_hits", _counted(calls := [], summary.hybrid_hits))
    rows = [{"request_id": "r", "query": "apple cherry", "query_vec": [1.0, 0.0]}, {"request_id": "no", "query": "zzz"}]
    asked = request_frame(spark, rows)
    found = {row["request_id"]: row for row in summary.explained_envelope(asked, store).collect()}
    assert len(calls) == 1 and set(found) == {"r", "no"}
    plain = {row["request_id"]: row for row in summary.explain_hybrid(asked, store).collect()}
    for name, row in found.items():
        own = plain[name].asDict(recursive=True)
        for part, value in row["explanation"].asDict(recursive=True).items():
            assert value == (pytest.approx(own[part]) if isinstance(value, float) else own[part])
        assert row["total_results"] == len(row["results"]) == own["results_found"]


def test_a_word_is_stemmed_once_in_a_batch():
    class Asked(dict):
        def __missing__(self, word):
            asked.append(word)
            return stem_word(word)

    asked = []
    lists = pa.array([["running", "dogs"], None, [], ["dogs", None, "dogs"]], pa.list_(pa.string()))
    assert stemmed(lists, Asked()).to_pylist() == [["run", "dog"], None, [], ["dog", None, "dog"]]
    assert sorted(asked) == ["dogs", "running"]
    assert stemmed(lists[2:], Asked()).to_pylist() == [[], ["dog", None, "dog"]]


def test_grams_are_sorted_where_they_are_made(spark, tables, tmp_path, monkeypatch):
    def refused(*given):
        raise AssertionError("grams moved")

    opened = Store(spark, tables, str(tmp_path))
    made = sorted(map(tuple, layouts.block_grams(opened.passages().where("linked")).collect()))
    monkeypatch.setattr(type(opened.passages()), "repartitionByRange", refused)
    rows = opened.grams().select("gram", "block", "slots", F.col("_metadata.file_name").alias("file")).collect()
    assert sorted((r["gram"], r["block"], r["slots"]) for r in rows) == made
    for file in {r["file"] for r in rows}:
        held = [(r["gram"], r["block"]) for r in rows if r["file"] == file]
        assert held == sorted(held)
