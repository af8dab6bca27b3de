"""Searches that read some blocks only: same rows, less read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plan_rows import rows_read
from shared_rows import SF_DIR
from gleaner.functions.grams import gram_numbers, pattern_grams
from gleaner.operators import bm25, substring
from gleaner.operators.bm25 import bm25_hits
from gleaner.operators.requests import request_frame, resolved_batch
from gleaner.operators.substring import substring_hits
from gleaner.plans import store as layouts
from gleaner.plans.store import Store
from gleaner.sources.raw import logical_tables


@pytest.fixture(scope="module")
def small_blocks(spark, tmp_path_factory):
    """A store cut as a large one is: many blocks, small pages."""
    patch = pytest.MonkeyPatch()
    patch.setattr(layouts, "_CHUNKS_PER_BLOCK", 8)
    patch.setattr(layouts, "_POSTINGS_PER_PAGE", 8)
    patch.setattr(layouts, "_PASSAGES_PER_PAGE", 8)
    patch.setattr(layouts, "_POSTINGS_PER_PEAK", 2)
    yield Store(spark, logical_tables(spark, SF_DIR), str(tmp_path_factory.mktemp("blocks")))
    patch.undo()


def batch_of(spark, store, rows):
    return resolved_batch(spark, request_frame(spark, rows).collect(), store.companies)


def found(frame, score=None):
    return sorted((r["request_id"], r["rank"], r["chunk_id"], score and round(r[score], 8)) for r in frame.collect())


def test_a_block_lies_in_one_place(small_blocks):
    places = small_blocks.passages().groupBy("block").agg(F.countDistinct("part").alias("n"))
    assert places.where("n > 1").isEmpty() and places.count() > 100
    files = small_blocks.postings().groupBy("block").agg(F.countDistinct(F.col("_metadata.file_name")).alias("n"))
    assert files.where("n > 1").isEmpty()


@pytest.mark.parametrize(
    "rows",
    [
        [{"request_id": "the", "query": "the", "limit": 5}],
        [{"request_id": "two", "query": "the license", "limit": 5}, {"request_id": "one", "query": "nicht", "limit": 3}],
        [{"request_id": "few", "query": "the", "limit": 20, "ciks": ["3"]}],
        [{"request_id": "score", "query": "the license nicht", "limit": 50, "min_score": 1.5}],
        [{"request_id": "no", "query": "revenue"}, {"request_id": "blank", "query": "123"}],
        [{"request_id": "more than there are", "query": "license", "limit": 100}],
    ],
)
def test_weighed_blocks_give_the_same_rows(spark, small_blocks, rows):
    batch = batch_of(spark, small_blocks, rows)
    plain = found(bm25_hits(batch, small_blocks, weigh=False), "fts_score")
    assert found(bm25_hits(batch, small_blocks, weigh=True), "fts_score") == plain


def test_a_common_word_reads_few_postings(spark, small_blocks):
    batch = batch_of(spark, small_blocks, [{"request_id": "r", "query": "the", "limit": 5}])
    every = small_blocks.postings().where("term = 'the'").count()
    plain, weighed = bm25_hits(batch, small_blocks, weigh=False), bm25_hits(batch, small_blocks, weigh=True)
    assert found(plain, "fts_score") == found(weighed, "fts_score")
    assert rows_read(plain, "tf") >= every
    assert 0 < rows_read(weighed, "tf") < 0.3 * every


def test_too_many_blocks_to_name(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(bm25, "MAX_NAMED_BLOCKS", 3)
    batch = batch_of(spark, small_blocks, [{"request_id": "r", "query": "the license", "limit": 20}])
    assert found(bm25_hits(batch, small_blocks, weigh=True)) == found(bm25_hits(batch, small_blocks, weigh=False))


PATTERNS = [
    {"request_id": "rare", "query": "License", "limit": 30},
    {"request_id": "wild", "query": "th_le%nicht", "limit": 30},
    {"request_id": "none", "query": "no such text anywhere"},
    {"request_id": "short", "query": "th", "limit": 4},
    {"request_id": "only wild", "query": "%_%", "limit": 4},
    {"request_id": "common", "query": "the", "limit": 4, "ciks": ["3", "4"]},
    {"request_id": "accents", "query": "ouÈ", "limit": 4},
    {"request_id": "slash", "query": "a\\", "limit": 4},
]


@pytest.mark.parametrize("most", [500_000, 40, 0])
@pytest.mark.parametrize("named", [2_000, 0])
def test_indexed_substrings_give_the_same_rows(spark, small_blocks, monkeypatch, most, named):
    monkeypatch.setattr(substring, "MOST_BLOCKS", most)
    monkeypatch.setattr(substring, "MAX_NAMED_BLOCKS", named)
    batch = batch_of(spark, small_blocks, PATTERNS)
    assert found(substring_hits(batch, small_blocks, True)) == found(substring_hits(batch, small_blocks, False))


def test_text_read_falls_with_selectivity(spark, small_blocks):
    every = small_blocks.passages().count()
    rows = small_blocks.passages().where("linked AND length(chunk_text) > 100").orderBy("chunk_id").select("chunk_text").limit(1).collect()
    read = {}
    for name, pattern in (("one", rows[0]["chunk_text"][20:60]), ("some", "license"), ("nothing", "no such text")):
        batch = batch_of(spark, small_blocks, [{"request_id": "r", "query": pattern, "limit": 100}])
        hits = substring_hits(batch, small_blocks, True)
        assert found(hits) == found(substring_hits(batch, small_blocks, False))
        read[name] = rows_read(hits, "chunk_text")
    assert read["nothing"] == 0 < read["one"] <= 0.05 * every
    assert read["one"] < read["some"] < every


def test_grams():
    assert len(gram_numbers("ab")) == 0 and len(gram_numbers("aaaa")) == 1
    assert pattern_grams("AB%cd_efg") == pattern_grams("efg")
    assert pattern_grams("%__%") == []
    assert set(pattern_grams("ouÈx")) == set(gram_numbers("ouèx").tolist())
    assert len(set(gram_numbers("a𝒳b").tolist()) & set(gram_numbers("ba𝒳b!").tolist())) == 1
