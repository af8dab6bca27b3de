from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared_rows import CHUNK_ROWS, DOCUMENT_ROWS, SF_DIR
from gleaner.operators.bm25 import bm25_hits, bm25_search
from gleaner.operators.hybrid import fuse, hybrid_search, normalized_weights
from gleaner.operators.lsh import vector_search_lsh
from gleaner.operators.presets import simple_search
from gleaner.operators.requests import request_frame, resolved_batch
from gleaner.operators.substring import substring_search, text_search
from gleaner.operators.vector import vector_search
from gleaner.plans.store import Analyzer, Store
from gleaner.schemas import EMBEDDINGS, RESULT_COLUMNS

CIK = {doc: cik for doc, cik, _ in DOCUMENT_ROWS}
LINKED = {c: CIK[d] for c, s, d, _ in CHUNK_ROWS if s != "missing" and d in CIK}


def _terms(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [t for t in re.split("[^a-z]+", plain) if t]


def brute_bm25(query, k1=1.2, b=0.75):
    docs = {c: Counter(_terms(t)) for c, _, _, t in CHUNK_ROWS}
    lengths = {c: sum(counts.values()) for c, counts in docs.items()}
    with_tokens = [n for n in lengths.values() if n]
    average = sum(with_tokens) / len(with_tokens)
    scores = Counter()
    for term in set(_terms(query)):
        df = sum(term in counts for counts in docs.values())
        idf = math.log10((len(docs) - df + 0.5) / (df + 0.5) + 1)
        for c, counts in docs.items():
            if term in counts and c in LINKED:
                tf = counts[term]
                scores[c] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[c] / average))
    return sorted(scores.items(), key=lambda e: (-round(e[1], 9), e[0]))


def run(spark, search, store, rows):
    asked = request_frame(spark, [{"query": "q", **row} for row in rows])
    found = {}
    for row in search(asked, store).orderBy("request_id", "rank").collect():
        found.setdefault(row["request_id"], []).append(row)
    return found


def ids(rows):
    return [row["chunk_id"] for row in rows or []]


# -- keyword ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("query", ["apple", "apple banana", "Cherry APPLE pie pie", "creme 100", "zebra", "42"])
def test_bm25_matches_brute_force(spark, store, query):
    found = run(spark, bm25_search, store, [{"request_id": "r", "query": query}]).get("r", [])
    expected = brute_bm25(query)
    assert ids(found) == [c for c, _ in expected]
    assert [row["fts_score"] for row in found] == pytest.approx([s for _, s in expected])


def test_filters_keep_scores(spark, store):
    found = run(
        spark,
        bm25_search,
        store,
        [
            {"request_id": "all", "query": "apple"},
            {"request_id": "some", "query": "apple", "tickers": ["bbb"]},
            {"request_id": "ciks", "query": "apple", "ciks": ["1", "3"]},
            {"request_id": "none", "query": "apple", "tickers": ["nope"]},
        ],
    )
    scores = {row["chunk_id"]: row["fts_score"] for row in found["all"]}
    assert ids(found["some"]) == ["c3"] and set(ids(found["ciks"])) == {"c1", "c4"}
    assert "none" not in found
    for row in found["some"] + found["ciks"]:
        assert row["fts_score"] == pytest.approx(scores[row["chunk_id"]])


def test_batch_is_the_union_of_single_requests(spark, store):
    rows = [{"request_id": q, "query": q, "limit": 2} for q in ("apple", "banana cherry", "pie")]
    together = run(spark, bm25_search, store, rows)
    for row in rows:
        alone = run(spark, bm25_search, store, [row])
        assert ids(alone[row["request_id"]]) == ids(together[row["request_id"]])


def test_equal_scores_follow_chunk_ids(spark, store):
    found = run(spark, bm25_search, store, [{"request_id": "r", "query": "banana cherry"}])["r"]
    assert ids(found)[:2] == ["c2", "c7"]
    assert found[0]["fts_score"] == pytest.approx(found[1]["fts_score"])


def test_min_score_and_limit(spark, store):
    best = brute_bm25("apple")[0][1]
    rows = [
        {"request_id": "high", "query": "apple", "min_score": best + 1},
        {"request_id": "edge", "query": "apple", "min_score": best - 1e-6},
        {"request_id": "zero", "query": "apple", "min_score": 0.0},
        {"request_id": "one", "query": "apple", "limit": 1},
    ]
    found = run(spark, bm25_search, store, rows)
    assert "high" not in found
    assert len(found["edge"]) == 1 and len(found["zero"]) == 3 and len(found["one"]) == 1


def test_result_rows(spark, store):
    row = run(spark, bm25_search, store, [{"request_id": "r", "query": "pie"}])["r"][0]
    assert tuple(row.asDict()) == RESULT_COLUMNS
    assert (row["doc_id"], row["cik"], row["company_name"], row["method"]) == ("d2", "2", "Beta%Corp", "fts")
    assert (row["rank"], row["section_name"], row["char_count"]) == (1, "name s2", 20)
    assert row["vector_score"] is None and row["combined_score"] is None


def test_company_name_is_null_without_a_listing(spark, store):
    row = run(spark, bm25_search, store, [{"request_id": "r", "query": "creme"}])["r"][0]
    assert row["cik"] == "9" and row["company_name"] is None


def test_english_analyzer_joins_word_forms(spark, store):
    english = Analyzer.english()
    found = run(
        spark, lambda a, s: bm25_search(a, s, english), store, [{"request_id": "r", "query": "the apples"}]
    )
    assert set(ids(found["r"])) == {"c1", "c3", "c4"}


def test_many_terms_take_the_unnamed_path(spark, store, monkeypatch):
    from gleaner.operators import bm25

    rows = [{"request_id": "r", "query": "apple banana pie"}, {"request_id": "s", "query": "cherry", "ciks": ["3"]}]
    expected = run(spark, bm25_search, store, rows)
    monkeypatch.setattr(bm25, "FEW_TERMS", 1)
    for bound in ("MAX_NAMED_TERMS", "TERMS_AT_ONCE"):
        monkeypatch.setattr(bm25, bound, 1)
        found = run(spark, bm25_search, store, rows)
        assert {k: ids(v) for k, v in found.items()} == {k: ids(v) for k, v in expected.items()}


def test_both_ways_of_scoring_agree(spark, store, monkeypatch):
    from gleaner.operators import bm25

    rows = [
        {"request_id": "plain", "query": "apple banana pie zebra"},
        {"request_id": "tickers", "query": "apple cherry", "tickers": ["bbb", "ccc"]},
        {"request_id": "ciks", "query": "cherry banana", "ciks": ["1"], "limit": 1},
        {"request_id": "least", "query": "apple pie", "min_score": 0.3},
        {"request_id": "zero", "query": "creme", "min_score": 0.0},
        {"request_id": "nowhere", "query": "apple", "tickers": ["nope"]},
    ]

    def rounded(found):
        return {k: [(r["chunk_id"], round(r["fts_score"], 9)) for r in v] for k, v in found.items()}

    expected = rounded(run(spark, bm25_search, store, rows))
    monkeypatch.setattr(bm25, "FEW_TERMS", 0)
    monkeypatch.setattr(bm25, "DENSE_SHARE", 0.0)
    assert rounded(run(spark, bm25_search, store, rows)) == expected
    filtered = [row for row in rows if row.get("tickers") or row.get("ciks")]
    assert rounded(run(spark, bm25_search, store, filtered)) == {
        k: v for k, v in expected.items() if k in ("tickers", "ciks")
    }


def test_blank_preset_finds_nothing(store):
    assert simple_search(store, "   ").count() == 0


# -- substring --------------------------------------------------------------------------------------


def test_substring(spark, store):
    rows = [
        {"request_id": "a", "query": "PIE", "min_score": 99.0},
        {"request_id": "wild", "query": "b%c"},
        {"request_id": "percent", "query": "100%"},
        {"request_id": "slash", "query": "\\"},
        {"request_id": "cik", "query": "cherry", "ciks": ["1"]},
        {"request_id": "orphan", "query": "orphan"},
        {"request_id": "two", "query": "a", "limit": 2},
    ]
    found = run(spark, substring_search, store, rows)
    assert ids(found["a"]) == ["c3"] and found["a"][0]["fts_score"] is None
    assert ids(found["wild"]) == ["c2", "c7"]
    assert ids(found["percent"]) == ["c5"]
    assert ids(found["cik"]) == ["c2"]
    assert ids(found["two"]) == ["c1", "c2"]
    assert "slash" not in found and "orphan" not in found


def test_text_search_picks_its_method(spark, store):
    rows = [{"request_id": "r", "query": "ppl"}]
    assert run(spark, text_search, store, rows) == {}
    fallback = run(spark, lambda a, s: text_search(a, s, indexed=False), store, rows)
    assert ids(fallback["r"]) == ["c1", "c3", "c4"]


# -- vector -----------------------------------------------------------------------------------------


def test_vector_search(spark, store):
    found = run(spark, vector_search, store, [{"request_id": "r", "query_vec": [2.0, 0.0]}])["r"]
    # c4 has no direction, c6 the wrong length, x1 no section, "gone" no chunk.
    assert ids(found) == ["c1", "c2", "c5", "c3", "c7"]
    assert [row["distance"] for row in found] == pytest.approx([0, 1 - 0.5**0.5, 1 - 0.5**0.5, 1, 2])
    assert [row["vector_score"] for row in found] == pytest.approx([1, 0.5**0.5, 0.5**0.5, 0, 0])


def test_vector_limits_filters_and_distances(spark, store):
    vec = [1.0, 0.0]
    rows = [
        {"request_id": "near", "query_vec": vec, "max_distance": 0.5},
        {"request_id": "zero", "query_vec": vec, "max_distance": 0.0},
        {"request_id": "top", "query_vec": vec, "limit": 2},
        {"request_id": "cik", "query_vec": vec, "ciks": ["2", "9"]},
        {"request_id": "nowhere", "query_vec": vec, "tickers": ["nope"]},
        {"request_id": "hidden", "query_vec": vec, "include_distances": False, "limit": 1},
        {"request_id": "still", "query_vec": [0.0, 0.0]},
        {"request_id": "without"},
    ]
    found = run(spark, vector_search, store, rows)
    assert ids(found["near"]) == ["c1", "c2", "c5"]
    assert len(found["zero"]) == 5
    assert ids(found["top"]) == ["c1", "c2"]
    assert ids(found["cik"]) == ["c5", "c3", "c7"]
    assert found["hidden"][0]["distance"] is None and found["hidden"][0]["vector_score"] == pytest.approx(1)
    assert {"nowhere", "still", "without"}.isdisjoint(found)


def test_wrong_query_length_is_an_error(spark, store):
    with pytest.raises(ValueError, match="2 values"):
        run(spark, vector_search, store, [{"request_id": "r", "query_vec": [1.0, 2.0, 3.0]}])


def test_task_function_keeps_the_best_over_batches():
    from gleaner.functions.blocks import nearest_vectors
    import pyarrow as pa

    rng = np.random.default_rng(5)
    matrix = np.round(rng.normal(size=(500, 4)), 1)
    matrix[100:300] = matrix[100]
    queries = rng.normal(size=(3, 4))
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    names = [f"c{n:03d}" for n in rng.permutation(500)]
    ciks = [str(n % 3) for n in range(500)]
    norms = np.linalg.norm(matrix, axis=1)
    batches = [
        pa.RecordBatch.from_arrays(
            [
                pa.array(names[i : i + 70]),
                pa.array(ciks[i : i + 70]),
                pa.array(matrix[i : i + 70].tolist(), pa.list_(pa.float32())),
                pa.array(norms[i : i + 70]),
            ],
            names=["chunk_id", "cik", "embedding", "norm"],
        )
        for i in range(0, 500, 70)
    ]
    search = nearest_vectors(["a", "b", "c"], [10, 40, 100], [None, 0.5, None], [None, None, frozenset("1")], queries)
    found = {}
    for batch in search(iter(batches)):
        for row in batch.to_pylist():
            found.setdefault(row["request_id"], []).append(row["chunk_id"])
    distances = 1 - (matrix.astype(np.float32).astype(float) @ queries.T) / norms[:, None]

    def expected(n, limit, keep):
        rows = [r for r in range(500) if keep(r)]
        return [names[r] for r in sorted(rows, key=lambda r: (round(distances[r, n], 9), names[r]))][:limit]

    assert found["a"] == expected(0, 10, lambda r: True)
    assert found["b"] == expected(1, 40, lambda r: distances[r, 1] <= 0.5)
    assert found["c"] == expected(2, 100, lambda r: ciks[r] == "1")


def test_vector_search_without_vectors(spark, tables, tmp_path):
    bare = Store(spark, {k: v for k, v in tables.items() if k != EMBEDDINGS}, str(tmp_path))
    assert run(spark, vector_search, bare, [{"request_id": "r", "query_vec": [1.0, 0.0]}]) == {}


def test_lsh_recall(spark):
    from gleaner.plans.open import store_for
    from shared_rows import SF_DIR
    from gleaner.sources.raw import raw

    opened = store_for(spark, SF_DIR)
    vectors = raw(spark, SF_DIR, "embeddings").orderBy("vec_id").limit(20).collect()
    rows = [{"request_id": str(r["vec_id"]), "query_vec": r["embedding"], "limit": 5} for r in vectors]
    exact = run(spark, vector_search, opened, rows)
    near = run(spark, lambda a, s: vector_search_lsh(a, s, bucket_length=2.0, tables=10), opened, rows)
    hit = sum(len(set(ids(exact[k])) & set(ids(near.get(k)))) for k in exact)
    assert hit / sum(len(v) for v in exact.values()) >= 0.9
    for key, found in near.items():
        assert ids(found)[0] == ids(exact[key])[0]


# -- fusion -----------------------------------------------------------------------------------------

FTS = "request_id string, chunk_id string, fts_score double, rank int"
VEC = "request_id string, chunk_id string, distance double, vector_score double, rank int"


def fused(spark, fts, vec, wf=0.5, wv=0.5, normalize=True):
    asked = request_frame(
        spark,
        [{"request_id": "r", "query": "q", "fts_weight": wf, "semantic_weight": wv, "normalize_scores": normalize}],
    )
    rows = fuse(
        spark.createDataFrame([("r", *row) for row in fts], FTS),
        spark.createDataFrame([("r", *row) for row in vec], VEC),
        normalized_weights(asked),
    ).collect()
    return {row["chunk_id"]: row for row in rows}


def test_fusion_scores(spark):
    rows = fused(
        spark, [("a", 4.0, 1), ("b", 2.0, 2)], [("b", 0.2, 0.8, 1), ("c", 0.6, 0.4, 2)], wf=0.2, wv=0.6
    )
    assert rows["a"]["combined_score"] == pytest.approx(0.25 * 1.0)
    assert rows["b"]["combined_score"] == pytest.approx(0.25 * 0.5 + 0.75 * 1.0)
    assert rows["c"]["combined_score"] == pytest.approx(0.75 * 0.5)
    assert (rows["a"]["vector_score"], rows["a"]["distance"]) == (0.0, None)
    assert (rows["c"]["fts_score"], rows["c"]["distance"]) == (0.0, 0.6)
    assert {(r["fts_results"], r["vector_results"], r["combined_unique"]) for r in rows.values()} == {(2, 2, 3)}


def test_fusion_of_raw_and_of_zero_scores(spark):
    rows = fused(spark, [("a", 4.0, 1)], [("a", 0.5, 0.5, 1)], normalize=False)
    assert rows["a"]["combined_score"] == pytest.approx(0.5 * 4 + 0.5 * 0.5)
    rows = fused(spark, [("a", 0.0, 1)], [("b", 1.5, 0.0, 1)])
    assert rows["a"]["combined_score"] == 0.0 and rows["b"]["combined_score"] == 0.0


def test_hybrid_order_on_draws(spark, store):
    # Both candidate lists score 0 for vectors: keyword hits come first, in their order.
    rows = [{"request_id": "r", "query": "banana cherry", "query_vec": [-1.0, 0.0], "fts_weight": 0.0001, "limit": 9}]
    found = run(spark, hybrid_search, store, rows)["r"]
    assert ids(found)[0] == "c7"
    text_only = [row["chunk_id"] for row in found if row["fts_score"] > 0]
    assert text_only.index("c2") < text_only.index("c4")


def test_text_weight_only_reproduces_text_order(spark, store):
    vec = [1.0, 0.0]
    rows = [{"request_id": "r", "query": "apple cherry", "query_vec": vec, "fts_weight": 1.0, "semantic_weight": 0.0}]
    found = run(spark, hybrid_search, store, rows)["r"]
    text = run(spark, bm25_search, store, rows)["r"]
    assert ids(found) == ids(text)
    assert found[0]["combined_score"] == pytest.approx(1.0)
    rows[0] |= {"fts_weight": 0.0, "semantic_weight": 1.0}
    assert ids(run(spark, hybrid_search, store, rows)["r"]) == ids(run(spark, vector_search, store, rows)["r"])


def test_weights_of_zero_are_refused(spark, store):
    with pytest.raises(ValueError, match="greater than 0"):
        run(spark, hybrid_search, store, [{"request_id": "r", "fts_weight": 0.0, "semantic_weight": 0.0}])


def test_hybrid_ignores_thresholds_and_overfetches(spark, store):
    vec = [1.0, 0.0]
    rows = [{"request_id": "r", "query": "apple", "query_vec": vec, "min_score": 50.0, "max_distance": 0.01, "limit": 1}]
    batch = resolved_batch(spark, request_frame(spark, rows).collect(), store.companies)
    from gleaner.operators.hybrid import hybrid_hits

    counts = hybrid_hits(batch, store).select("fts_results", "vector_results").distinct().collect()
    assert [tuple(r) for r in counts] == [(3, 3)]


def test_hybrid_without_vectors(spark, tables, tmp_path):
    bare = Store(spark, {k: v for k, v in tables.items() if k != EMBEDDINGS}, str(tmp_path))
    rows = [{"request_id": "r", "query": "apple", "query_vec": [1.0, 0.0]}]
    assert ids(run(spark, hybrid_search, bare, rows)["r"]) == [c for c, _ in brute_bm25("apple")]


def test_candidates_of_a_task_do_not_depend_on_partitions(spark, store):
    asked = request_frame(spark, [{"request_id": "r", "query": "apple banana cherry"}])
    batch = resolved_batch(spark, asked.collect(), store.companies)
    hits = bm25_hits(batch, store).select("chunk_id", F.round("fts_score", 9).alias("s"), "rank").collect()
    assert [row["rank"] for row in sorted(hits, key=lambda r: (-r["s"], r["chunk_id"]))] == list(
        range(1, len(hits) + 1)
    )


@pytest.mark.parametrize("search", [bm25_search, vector_search, hybrid_search])
@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ({"limit": 0}, "limit out of bounds"),
        ({"limit": 150}, "limit out of bounds"),
        ({"min_score": -1.0}, "min_score"),
        ({"max_distance": 3.0}, "max_distance"),
        ({"request_id": None}, "no request id"),
    ],
)
def test_faulty_requests_are_refused(spark, store, search, row, reason):
    with pytest.raises(ValueError, match=reason):
        run(spark, search, store, [{"request_id": "r", "query": "apple", "query_vec": [1.0, 0.0], **row}])


def test_repeated_ids_are_refused_before_any_batch(spark, store):
    from gleaner.operators.requests import in_batches

    asked = request_frame(spark, [{"request_id": "r", "query": "apple"}] * 3)
    for most in (1000, 2):
        with pytest.raises(ValueError, match="not unique"):
            in_batches(asked, store.companies, lambda batch: pytest.fail("ran"), max_batch=most)


def test_analyzers_of_one_name_do_not_share_layouts(spark, store):
    rows = [{"request_id": "r", "query": "apple banana"}]
    plain = run(spark, bm25_search, store, rows)["r"]
    less = run(spark, lambda a, s: bm25_search(a, s, Analyzer("plain", ("apple",))), store, rows)["r"]
    assert {r["chunk_id"] for r in less} < {r["chunk_id"] for r in plain}
    assert Analyzer("plain", ("a",)).layout != Analyzer("plain", ("b",)).layout != Analyzer().layout


def test_document_lookups_read_no_text(spark):
    from gleaner.operators.lookup import find_documents, get_document
    from gleaner.plans.open import store_for
    from gleaner.schemas import DOCUMENTS

    opened = store_for(spark, SF_DIR)
    tables = {**opened.tables, DOCUMENTS: opened.documents()}
    for frame in (find_documents(tables, year=2018), get_document(tables[DOCUMENTS], "7")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "text:string" not in plan and "EqualTo" in plan


def test_owners_are_distinct_before_the_shuffle(spark):
    from gleaner.operators.lookup import companies_with_documents
    from gleaner.plans.open import store_for

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = companies_with_documents(store_for(spark, SF_DIR).tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("Exchange hashpartitioning(owner") :]
    assert "HashAggregate" in below
