"""Request tables beyond a batch: few passes, the rows of single requests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shared_rows import SF_DIR
from gleaner.operators import ranking, requests as tables
from gleaner.operators.bm25 import bm25_hits
from gleaner.operators.ranking import ranked
from gleaner.operators.requests import in_batches, request_frame, resolved_batch
from gleaner.operators.vector import vector_hits
from gleaner.plans.open import store_for
from gleaner.sources.raw import raw

WORDS = ("the", "license", "nicht", "thble", "thtion", "of", "revenue")


def asked_rows(spark, n):
    vectors = [r["embedding"] for r in raw(spark, SF_DIR, "embeddings").orderBy("vec_id").limit(40).collect()]
    return [
        {
            "request_id": f"r{i}",
            "query": f"{WORDS[i % 7]} {WORDS[i // 7 % 7]}",
            "query_vec": vectors[i % len(vectors)],
            "limit": 1 + i % 5,
            "ciks": [str(i % 11)] if i % 3 == 0 else None,
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("hits", [bm25_hits, vector_hits])
def test_few_passes_give_the_rows_of_single_requests(spark, hits):
    opened = store_for(spark, SF_DIR)
    rows = asked_rows(spark, 120)
    sizes = []

    def search(batch):
        sizes.append(len(batch.rows))
        return hits(batch, opened)

    asked = request_frame(spark, rows)
    found = in_batches(asked, opened.companies, search, max_batch=10, shared_pass=True)
    found = sorted((r["request_id"], r["rank"], r["chunk_id"]) for r in found.collect())
    assert len(sizes) <= 2 and sum(sizes) == len(rows)
    for row in rows[::17]:
        one = resolved_batch(spark, request_frame(spark, [row]).collect(), opened.companies)
        expected = sorted((r["request_id"], r["rank"], r["chunk_id"]) for r in hits(one, opened).collect())
        assert [hit for hit in found if hit[0] == row["request_id"]] == expected


@pytest.mark.parametrize(("name", "value", "least"), [("PASS_REQUESTS", 30, 4), ("PASS_ROWS", 90, 4), ("PASS_VALUES", 64 * 25, 4)])
def test_a_pass_is_bounded(spark, monkeypatch, name, value, least):
    monkeypatch.setattr(tables, name, value)
    opened = store_for(spark, SF_DIR)
    batches = []

    def search(batch):
        batches.append(batch.rows)
        return vector_hits(batch, opened).limit(0)

    in_batches(request_frame(spark, asked_rows(spark, 120)), opened.companies, search, max_batch=10, shared_pass=True)
    assert least <= len(batches) <= 12 and sum(map(len, batches)) == 120
    measure = {"PASS_REQUESTS": lambda r: 1, "PASS_ROWS": lambda r: r["limit"], "PASS_VALUES": lambda r: 64}[name]
    assert all(sum(map(measure, rows)) <= value for rows in batches)


def test_many_tasks_are_ranked_in_groups(spark, monkeypatch):
    hits = spark.range(0, 5000, 1, 40).select(
        (F.col("id") % 3).cast("string").alias("request_id"),
        F.pmod(F.xxhash64("id"), F.lit(97)).alias("score"),
        F.col("id").alias("chunk"),
        F.lit(20).alias("limit"),
    )
    order = (F.col("score").desc(), F.col("chunk"))
    plain = ranked(hits, *order, limit=F.col("limit"), most=100, tasks=40)
    monkeypatch.setattr(ranking, "TASKS_RANKED_AT_ONCE", 10)
    grouped = ranked(hits, *order, limit=F.col("limit"), most=100, tasks=40)
    text = grouped._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and text.count("WindowGroupLimit") == 4
    key = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert key(grouped) == key(plain) and grouped.columns == plain.columns
