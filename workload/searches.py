"""Keyword, substring, vector and hybrid searches and what is derived from their results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.operators import presets, summary
from gleaner.operators.bm25 import bm25_search
from gleaner.operators.hybrid import hybrid_search
from gleaner.operators.ivf import vector_search_bounded, vector_search_ivf
from gleaner.operators.lsh import vector_search_lsh
from gleaner.operators.requests import with_defaults
from gleaner.operators.substring import substring_search, text_search
from gleaner.operators.vector import vector_search
from gleaner.plans.open import work_folder
from gleaner.plans.store import Analyzer, Store
from gleaner.schemas import COMPANIES, DOCUMENTS, TICKERS
from gleaner.sources import sinks
from gleaner.sources.filing_json import filing_documents, filing_sections, read_filing_lines
from gleaner.sources.mixed_json import read_mixed_lines
from gleaner.sources.publish import publish, read_published, remove_old
from gleaner.sources.raw import raw
from gleaner.sources.ticker_json import read_exchange_table, read_ticker_map
from workload.registry import query, requests_for, store
from workload.sql import (
    BENCHMARK_REQUESTS,
    FTS_SCORES,
    HYBRID_SCORES,
    LABEL_REQUESTS,
    PAIRED_REQUESTS,
    fts_sql,
    hybrid_sql,
    request_cte,
    result_select,
    rounded,
    substring_sql,
    vector_sql,
    with_ctes,
)

KEYWORD = [{"request_id": "k", "query": "thble license Nicht", "limit": 20}]
KEYWORD_BATCH = [
    {"request_id": "common", "query": "the", "limit": 25},
    {"request_id": "mixed", "query": "the THTION license", "limit": 100},
    {"request_id": "none", "query": "revenue"},
    {"request_id": "accents", "query": "eauenaux ouè qui?"},
    {"request_id": "symbols", "query": "123 -- 456"},
]
KEYWORD_FILTERED = [
    {"request_id": "tickers", "query": "thble nicht", "tickers": ["tk0", "TK0B", "NOPE"]},
    {"request_id": "ciks", "query": "thtion", "ciks": ["3", "17"]},
    {"request_id": "both", "query": "the", "tickers": ["tk3", "tk4"], "ciks": ["4", "5"]},
    {"request_id": "nowhere", "query": "the", "tickers": ["NOPE"]},
    {"request_id": "empty", "query": "thble", "tickers": [], "ciks": []},
]
KEYWORD_SCORED = [
    {"request_id": "least", "query": "thble nicht license", "limit": 100, "min_score": 2.5},
    {"request_id": "zero", "query": "thble nicht license", "limit": 100, "min_score": 0.0},
]
SUBSTRING = [
    {"request_id": "word", "query": "License", "limit": 30},
    {"request_id": "wild", "query": "th_le%nicht", "limit": 30},
    {"request_id": "filtered", "query": "the", "tickers": ["tk5b"], "limit": 15},
    {"request_id": "scored", "query": "nicht", "min_score": 99.0},
    {"request_id": "none", "query": "no such text"},
]
SUBSTRING_RARE = [
    {"request_id": "inside", "query": "hble nic", "limit": 40},
    {"request_id": "short", "query": "q%_", "limit": 10},
    {"request_id": "accents", "query": "EAUENAUX OUÈ", "limit": 10},
    {"request_id": "signs", "query": "ENSE. ", "limit": 10},
]
VECTOR = [{"request_id": "v", "query": "vector 0", "vec_id": 0, "limit": 20}]
VECTOR_FILTERED = [
    {"request_id": "tickers", "query": "v", "vec_id": 0, "tickers": ["tk0", "TK0B", "NOPE"], "limit": 100},
    {"request_id": "ciks", "query": "v", "vec_id": 1, "ciks": ["3", "17"], "limit": 15},
    {"request_id": "nowhere", "query": "v", "vec_id": 2, "tickers": ["NOPE"]},
]
VECTOR_BOUNDED = [
    {"request_id": "near", "query": "v", "vec_id": 0, "max_distance": 0.7, "limit": 100},
    {"request_id": "zero", "query": "v", "vec_id": 3, "max_distance": 0.0},
    {"request_id": "hidden", "query": "v", "vec_id": 5, "include_distances": False},
]
HYBRID = [{"request_id": "h", "query": "thble license nicht", "vec_id": 0, "limit": 20}]
HYBRID_BATCH = [
    {"request_id": "default", "query": "the thtion", "vec_id": 0},
    {"request_id": "wide", "query": "thble nicht", "vec_id": 365, "limit": 60},
    {"request_id": "heavy", "query": "license", "vec_id": 334, "fts_weight": 1.0, "semantic_weight": 0.5},
    {"request_id": "raw", "query": "thble license", "vec_id": 7, "normalize_scores": False, "limit": 40},
    {"request_id": "text", "query": "thble", "vec_id": 3, "fts_weight": 1.0, "semantic_weight": 0.0},
    {"request_id": "vector", "query": "thble", "vec_id": 3, "fts_weight": 0.0, "semantic_weight": 1.0},
    {"request_id": "filtered", "query": "the", "vec_id": 0, "tickers": ["tk0"], "ciks": ["0", "1"]},
    {"request_id": "bounds", "query": "the", "vec_id": 0, "min_score": 50.0, "max_distance": 0.1},
    {"request_id": "novector", "query": "nicht license", "limit": 15},
    {"request_id": "nothing", "query": "revenue", "tickers": ["NOPE"], "vec_id": 1},
]
# The three self-probes: words, and vectors standing in for their embeddings.
PROBES = [
    {"request_id": "fts", "query": "revenue", "limit": 3},
    {"request_id": "vector", "query": "artificial intelligence", "limit": 3, "vec_id": 1},
    {"request_id": "hybrid", "query": "revenue growth", "limit": 5, "vec_id": 2},
    # the same with words that the corpus holds
    {"request_id": "fts hits", "query": "thble", "limit": 3},
    {"request_id": "hybrid hits", "query": "thtion nicht", "limit": 5, "vec_id": 2},
]


def _search(name: str, rows: list[dict], run, sql):
    @query(name, sql(request_cte(rows)) if sql else None)
    def build(spark, sf_dir):
        return run(requests_for(spark, sf_dir, rows), store(spark, sf_dir))


_search("bm25_single", KEYWORD, bm25_search, fts_sql)
_search("bm25_batch", KEYWORD_BATCH, bm25_search, fts_sql)
_search("bm25_filtered", KEYWORD_FILTERED, bm25_search, fts_sql)
_search("bm25_min_score", KEYWORD_SCORED, bm25_search, fts_sql)
_search("substring_batch", SUBSTRING, substring_search, substring_sql)
# The same through bounds of blocks, which small corpora do without.
_search(
    "bm25_weighed_blocks",
    KEYWORD + KEYWORD_BATCH + KEYWORD_FILTERED + KEYWORD_SCORED,
    lambda requests, opened: bm25_search(requests, opened, weigh=True),
    fts_sql,
)
# The same and more through the index of three code points, which small corpora do without.
_search(
    "substring_indexed",
    SUBSTRING + SUBSTRING_RARE,
    lambda requests, opened: substring_search(requests, opened, indexed=True),
    substring_sql,
)


def _text_search_indexed(requests, opened):
    """In a ranked store words are ranked, whatever has been built."""
    return text_search(requests, opened)


def _text_search_fallback(requests, opened):
    """A store that is not ranked is searched by substring."""
    bare = Store(opened.spark, opened.tables, f"{opened.path}/bare-{uuid.uuid4().hex}", ranked=False)
    return text_search(requests, bare)


_search("text_search_indexed", KEYWORD, _text_search_indexed, fts_sql)
_search("text_search_fallback", KEYWORD_FILTERED, _text_search_fallback, substring_sql)

STOPWORDS = ("the", "of", "and", "nicht")


def _without_stopwords(sql: str) -> str:
    listed = ", ".join(f"'{word}'" for word in STOPWORDS)
    return sql.replace("WHERE term <> ''", f"WHERE term <> '' AND term NOT IN ({listed})")


_search(
    "bm25_stopwords",
    KEYWORD_BATCH + KEYWORD_FILTERED,
    lambda requests, opened: bm25_search(requests, opened, Analyzer.without(STOPWORDS)),
    lambda req: _without_stopwords(fts_sql(req)),
)
_search("vector_single", VECTOR, vector_search, vector_sql)
_search("vector_filtered", VECTOR_FILTERED, vector_search, vector_sql)
_search("vector_bounded", VECTOR_BOUNDED, vector_search, vector_sql)
_search("hybrid_single", HYBRID, hybrid_search, hybrid_sql)
_search("hybrid_batch", HYBRID_BATCH, hybrid_search, hybrid_sql)
_search(
    "bm25_english",
    KEYWORD_BATCH,
    lambda requests, opened: bm25_search(requests, opened, Analyzer.english()),
    None,
)
_search("vector_lsh", VECTOR + VECTOR_FILTERED, vector_search_lsh, None)
# Approximate search with its own bounds; with every list probed and many rows re-ranked it is exact.
_search("vector_ivf", VECTOR + VECTOR_FILTERED, vector_search_ivf, None)
_search("vector_bounded_lists", VECTOR + VECTOR_FILTERED + VECTOR_BOUNDED, vector_search_bounded, vector_sql)
_search(
    "vector_ivf_all_lists",
    VECTOR_FILTERED + VECTOR_BOUNDED,
    lambda requests, opened: vector_search_ivf(requests, opened, probes=10**6, overfetch=20),
    vector_sql,
)


def benchmark_requests(spark, sf_dir):
    """Every benchmark passage, whole, as a keyword query."""
    return with_defaults(
        raw(spark, sf_dir, "benchmark").select(
            F.concat(F.lit("b"), "item_id").alias("request_id"),
            F.col("text").alias("query"),
            F.lit(5).alias("limit"),
        )
    )


def label_requests(spark, sf_dir):
    """The rounded mean vector of every label as a query vector."""
    values = raw(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = values.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))
    # One entry per vector position.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda e: e["mean"])
    return with_defaults(
        means.groupBy("label")
        .agg(ordered.alias("query_vec"))
        .select(
            F.concat(F.lit("label"), "label").alias("request_id"),
            F.concat(F.lit("label "), "label").alias("query"),
            "query_vec",
        )
    )


@query("bm25_benchmark_passages", fts_sql(BENCHMARK_REQUESTS))
def bm25_benchmark_passages(spark, sf_dir):
    return bm25_search(benchmark_requests(spark, sf_dir), store(spark, sf_dir))


@query("vector_label_means", vector_sql(LABEL_REQUESTS))
def vector_label_means(spark, sf_dir):
    return vector_search(label_requests(spark, sf_dir), store(spark, sf_dir))


def paired_requests(spark, sf_dir):
    """Every benchmark passage with the vector of its number."""
    vectors = raw(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("b"), "vec_id").alias("request_id"), F.col("embedding").alias("query_vec")
    )
    asked = benchmark_requests(spark, sf_dir).drop("query_vec")
    return with_defaults(asked.join(vectors, "request_id", "left"))


@query(
    "vector_ivf_recall",
    f"SELECT request_id, true AS enough FROM ({LABEL_REQUESTS}) r",
)
def vector_ivf_recall(spark, sf_dir):
    """Whether the approximate search finds nine of ten of the exact one's hits, per request."""
    requests, opened = label_requests(spark, sf_dir), store(spark, sf_dir)
    exact = vector_search(requests, opened).select("request_id", "chunk_id")
    near = vector_search_ivf(requests, opened).select("request_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["request_id", "chunk_id"], "left").groupBy("request_id")
    return both.agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("vector_benchmark_passages", vector_sql(PAIRED_REQUESTS))
def vector_benchmark_passages(spark, sf_dir):
    return vector_search(paired_requests(spark, sf_dir), store(spark, sf_dir))


@query("hybrid_benchmark_passages", hybrid_sql(PAIRED_REQUESTS))
def hybrid_benchmark_passages(spark, sf_dir):
    return hybrid_search(paired_requests(spark, sf_dir), store(spark, sf_dir))


# -- presets --------------------------------------------------------------------------------------


def _preset_row(**given) -> str:
    return request_cte([{"request_id": "0", "limit": 20, **given}])


@query("preset_simple_search", fts_sql(_preset_row(query="thtion nicht")))
def preset_simple_search(spark, sf_dir):
    return presets.simple_search(store(spark, sf_dir), " thtion nicht ")


@query("preset_simple_vector_search", vector_sql(_preset_row(query="x", vec_id=0)))
def preset_simple_vector_search(spark, sf_dir):
    vector = requests_for(spark, sf_dir, VECTOR).first()["query_vec"]
    return presets.simple_vector_search(store(spark, sf_dir), "x", vector)


@query("preset_simple_hybrid_search", hybrid_sql(_preset_row(query="thtion", vec_id=0)))
def preset_simple_hybrid_search(spark, sf_dir):
    vector = requests_for(spark, sf_dir, VECTOR).first()["query_vec"]
    return presets.simple_hybrid_search(store(spark, sf_dir), "thtion", vector)


# -- what results consist of ----------------------------------------------------------------------


def _hybrid_results(spark, sf_dir, rows=HYBRID_BATCH):
    return hybrid_search(requests_for(spark, sf_dir, rows), store(spark, sf_dir))


_BATCH = request_cte(HYBRID_BATCH)
_LABELLED = "(SELECT h.*, l.cik, l.company_name FROM hybrid_hits h JOIN t_labels l ON l.chunk_id = h.chunk_id)"
_COMPOSITION = f"""
    c AS (SELECT request_id, coalesce(nullif(company_name, ''), cik) AS company, count(*) AS n
          FROM {_LABELLED} GROUP BY ALL),
    d AS (SELECT request_id, string_agg(company || '=' || n, '; ' ORDER BY n DESC, company) AS companies
          FROM c GROUP BY request_id),
    s AS (SELECT request_id, count(*) AS total_results,
                 count(*) FILTER (fts_score > 0 AND vector_score = 0) AS fts_only,
                 count(*) FILTER (fts_score = 0 AND vector_score > 0) AS vector_only,
                 count(*) FILTER (fts_score > 0 AND vector_score > 0) AS both_methods,
                 avg(combined_score) AS score_avg, min(combined_score) AS score_min,
                 max(combined_score) AS score_max, max(fts_results) AS fts_results,
                 max(vector_results) AS vector_results, max(combined_unique) AS combined_unique
          FROM hybrid_hits GROUP BY request_id)
"""


def _composition_sql(body: str) -> str:
    return with_ctes("SELECT 1", "hybrid_hits", "t_labels", "req", req=_BATCH).removesuffix(
        " SELECT 1"
    ) + f", {_COMPOSITION} {body}"


@query(
    "result_composition",
    _composition_sql(
        f"""
        SELECT r.request_id, coalesce(s.total_results, 0) AS total_results, s.fts_only, s.vector_only,
               s.both_methods, {rounded('s.score_avg', 'combined_score_avg')},
               {rounded('s.score_min', 'combined_score_min')},
               {rounded('s.score_max', 'combined_score_max')}, d.companies
        FROM req r LEFT JOIN s ON s.request_id = r.request_id LEFT JOIN d ON d.request_id = r.request_id
        """
    ),
)
def result_composition(spark, sf_dir):
    requests = requests_for(spark, sf_dir, HYBRID_BATCH)
    composed = summary.composition(hybrid_search(requests, store(spark, sf_dir)), requests)
    text = summary.distribution_text(F.col("company_distribution"))
    return composed.withColumn("companies", text).drop("company_distribution")


@query(
    "company_distribution",
    _composition_sql("SELECT request_id, company, n AS hits FROM c"),
)
def company_distribution(spark, sf_dir):
    return summary.company_distribution(_hybrid_results(spark, sf_dir))


@query(
    "hybrid_explanation",
    _composition_sql(
        f"""
        SELECT r.request_id, r.query AS original_query, 'hybrid' AS search_method,
               {rounded('r.fts_weight', 'fts_weight')}, {rounded('r.semantic_weight', 'semantic_weight')},
               r.normalize_scores AS normalized,
               {rounded('r.fts_weight / (r.fts_weight + r.semantic_weight)', 'normalized_fts_weight')},
               {rounded('r.semantic_weight / (r.fts_weight + r.semantic_weight)', 'normalized_semantic_weight')},
               coalesce(s.fts_results, 0) AS fts_results, coalesce(s.vector_results, 0) AS vector_results,
               coalesce(s.combined_unique, 0) AS combined_unique,
               'Performed FTS search for exact keyword matching' AS step_1,
               'Performed vector search for semantic similarity' AS step_2,
               'Combined results with weighted scoring' AS step_3,
               'Returned top ' || coalesce(s.total_results, 0) || ' results' AS step_4,
               coalesce(s.total_results, 0) AS results_found, s.fts_only, s.vector_only, s.both_methods,
               d.companies,
               {rounded('s.score_avg', 'combined_score_avg')},
               {rounded('s.score_min', 'combined_score_min')},
               {rounded('s.score_max', 'combined_score_max')}
        FROM req r LEFT JOIN s ON s.request_id = r.request_id LEFT JOIN d ON d.request_id = r.request_id
        """
    ),
)
def hybrid_explanation(spark, sf_dir):
    explained = summary.explain_hybrid(requests_for(spark, sf_dir, HYBRID_BATCH), store(spark, sf_dir))
    text = summary.distribution_text(F.col("company_distribution"))
    return explained.withColumn("companies", text).drop("company_distribution")


def _summary_sql(hits: str, method: str, fts: str, vector: str, combined: str) -> str:
    return f"""
        SELECT r.request_id, r.query AS test_query,
               CASE WHEN count(h.chunk_id) > 0 THEN '{method}' END AS method,
               count(h.chunk_id) AS results_found,
               count(*) FILTER (coalesce({fts}, 0) > 0) - count(*) FILTER (coalesce({fts}, 0) > 0 AND coalesce({vector}, 0) > 0) AS fts_only,
               count(*) FILTER (coalesce({vector}, 0) > 0) - count(*) FILTER (coalesce({fts}, 0) > 0 AND coalesce({vector}, 0) > 0) AS vector_only,
               count(*) FILTER (coalesce({fts}, 0) > 0 AND coalesce({vector}, 0) > 0) AS both_methods,
               CASE WHEN count(h.chunk_id) > 0 THEN {rounded(f'avg(coalesce({vector}, 0.0))', 'x').removesuffix(' AS x')} END AS avg_similarity,
               CASE WHEN count(h.chunk_id) > 0 THEN {rounded(f'avg(coalesce({combined}, 0.0))', 'x').removesuffix(' AS x')} END AS avg_combined_score
        FROM req r LEFT JOIN {hits} h ON h.request_id = r.request_id
        GROUP BY r.request_id, r.query
    """


def _probe(name: str, rows: list[dict], run, hits: str, method: str, fts: str, vector: str, combined: str):
    sql = with_ctes(_summary_sql(hits, method, fts, vector, combined), hits, "req", req=request_cte(rows))

    @query(name, sql)
    def build(spark, sf_dir):
        requests = requests_for(spark, sf_dir, rows)
        return summary.search_summary(run(requests, store(spark, sf_dir)), requests)


_probe("probe_fts", [PROBES[0]], bm25_search, "fts_hits", "fts", "h.fts_score", "NULL", "NULL")
_probe("probe_fts_hits", [PROBES[3]], bm25_search, "fts_hits", "fts", "h.fts_score", "NULL", "NULL")
_probe("probe_vector", [PROBES[1]], vector_search, "vector_hits", "vector", "NULL", "h.vector_score", "NULL")
_probe(
    "probe_hybrid",
    [PROBES[2]],
    hybrid_search,
    "hybrid_hits",
    "hybrid",
    "h.fts_score",
    "h.vector_score",
    "h.combined_score",
)
_probe(
    "probe_hybrid_hits",
    [PROBES[4]],
    hybrid_search,
    "hybrid_hits",
    "hybrid",
    "h.fts_score",
    "h.vector_score",
    "h.combined_score",
)
_probe(
    "summary_hybrid_batch",
    HYBRID_BATCH,
    hybrid_search,
    "hybrid_hits",
    "hybrid",
    "h.fts_score",
    "h.vector_score",
    "h.combined_score",
)

COMPARED = [
    {"request_id": "c1", "query": "thble nicht", "vec_id": 0, "limit": 15},
    {"request_id": "c2", "query": "license the", "vec_id": 9, "limit": 30, "ciks": ["9", "10", "11"]},
]


@query(
    "compare_methods",
    with_ctes(
        "SELECT *, count(*) OVER (PARTITION BY request_id, chunk_id) AS found_by FROM ("
        + " UNION ALL ".join(
            result_select(hits, method, scores)
            for hits, method, scores in (
                ("fts_hits", "fts", FTS_SCORES),
                ("vector_hits", "vector", {"vector_score": "h.vector_score", "distance": "h.distance"}),
                ("hybrid_hits", "hybrid", HYBRID_SCORES),
            )
        )
        + ")",
        "fts_hits",
        "vector_hits",
        "hybrid_hits",
        "t_labels",
        "req",
        req=request_cte(COMPARED),
    ),
)
def compare(spark, sf_dir):
    return summary.compare_methods(requests_for(spark, sf_dir, COMPARED), store(spark, sf_dir))


@query(
    "result_cards",
    with_ctes(
        f"""
        SELECT h.request_id, h.rank, coalesce(l.company_name, 'Unknown Company') AS company,
               l.section_name, l.filename, substr(l.chunk_text, 1, 300) || '...' AS excerpt,
               {rounded('h.fts_score', 'fts_score', 3)}, {rounded('h.vector_score', 'vector_score', 3)},
               {rounded('h.distance', 'distance', 3)}, {rounded('h.combined_score', 'combined_score', 3)}
        FROM hybrid_hits h JOIN t_labels l ON l.chunk_id = h.chunk_id
        """,
        "hybrid_hits",
        "t_labels",
        req=_BATCH,
    ),
)
def result_cards(spark, sf_dir):
    return summary.result_cards(_hybrid_results(spark, sf_dir))


@query(
    "legacy_results",
    with_ctes(
        f"""
        SELECT h.request_id, h.rank, l.doc_id, l.cik, l.filename, l.year,
               coalesce(nullif(l.company_name, ''), 'Unknown') AS company_name, l.section_name,
               l.chunk_text AS content_snippet, l.char_count,
               {rounded('coalesce(nullif(h.combined_score, 0), nullif(h.fts_score, 0), h.vector_score)', 'search_score')}
        FROM hybrid_hits h JOIN t_labels l ON l.chunk_id = h.chunk_id
        """,
        "hybrid_hits",
        "t_labels",
        req=_BATCH,
    ),
)
def legacy_results(spark, sf_dir):
    documents = store(spark, sf_dir).tables[DOCUMENTS]
    return summary.legacy_results(_hybrid_results(spark, sf_dir), documents)


@query("response_envelopes")
def response_envelopes(spark, sf_dir):
    requests = requests_for(spark, sf_dir, HYBRID_BATCH)
    results = hybrid_search(requests, store(spark, sf_dir))
    return sinks.response_json(summary.envelope(results, requests, "hybrid"))


@query(
    "responses_written_and_read",
    with_ctes(
        f"""
        SELECT r.request_id, r.query, 'hybrid' AS method, count(h.chunk_id) AS total_results,
               min(CASE WHEN h.rank = 1 THEN h.chunk_id END) AS first_chunk
        FROM req r LEFT JOIN hybrid_hits h ON h.request_id = r.request_id GROUP BY r.request_id, r.query
        """,
        "hybrid_hits",
        "req",
        req=_BATCH,
    ),
)
def responses_written_and_read(spark, sf_dir):
    """Envelopes written as JSON and read back."""
    requests = requests_for(spark, sf_dir, HYBRID_BATCH)
    results = hybrid_search(requests, store(spark, sf_dir))
    nested = summary.envelope(results, requests, "hybrid")
    path = f"{work_folder(spark, sf_dir)}/responses"
    sinks.write_responses(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select(
        "request_id",
        "query",
        "method",
        "total_results",
        F.get("results", F.lit(0))["chunk_id"].alias("first_chunk"),
    )


@query(
    "response_items",
    hybrid_sql(_BATCH),
)
def response_items(spark, sf_dir):
    """The items of the envelopes, laid flat again."""
    requests = requests_for(spark, sf_dir, HYBRID_BATCH)
    nested = summary.envelope(hybrid_search(requests, store(spark, sf_dir)), requests, "hybrid")
    return nested.select("request_id", "method", F.inline("results"))


@query(
    "explained_responses",
    _composition_sql(
        f"""
        SELECT r.request_id, coalesce(s.total_results, 0) AS total_results, coalesce(s.total_results, 0) AS items,
               coalesce(s.fts_results, 0) AS fts_results, coalesce(s.combined_unique, 0) AS combined_unique,
               'Returned top ' || coalesce(s.total_results, 0) || ' results' AS step_4,
               {rounded('s.score_avg', 'combined_score_avg')}
        FROM req r LEFT JOIN s ON s.request_id = r.request_id
        """
    ),
)
def explained_responses(spark, sf_dir):
    """Responses that carry their explanation."""
    found = summary.explained_envelope(requests_for(spark, sf_dir, HYBRID_BATCH), store(spark, sf_dir))
    return found.select(
        "request_id",
        "total_results",
        F.size("results").alias("items"),
        *[F.col(f"explanation.{c}").alias(c) for c in ("fts_results", "combined_unique", "step_4", "combined_score_avg")],
    )


# -- JSON sources ---------------------------------------------------------------------------------


@query("ticker_map_json", with_ctes("SELECT index_key, cik, ticker, title FROM t_tickers", "t_tickers"))
def ticker_map_json(spark, sf_dir):
    """The ticker table as index-keyed JSON maps, one per line, written and read back."""
    path = f"{work_folder(spark, sf_dir)}/ticker_map"
    entry = F.struct(F.col("cik").alias("cik_str"), "ticker", "title")
    lines = store(spark, sf_dir).tables[TICKERS].select(
        F.to_json(F.create_map(F.col("index_key").cast("string"), entry)).alias("value")
    )
    lines.write.mode("overwrite").text(path)
    return read_ticker_map(spark, path, whole_files=False)


@query(
    "exchange_table_json", with_ctes("SELECT cik, name, ticker, exchange FROM t_companies", "t_companies")
)
def exchange_table_json(spark, sf_dir):
    """The company directory as fields and data rows, one JSON object per line."""
    path = f"{work_folder(spark, sf_dir)}/exchange_table"
    fields = ["cik", "name", "ticker", "exchange"]
    row = F.array(*[F.col(c).cast("string") for c in fields])
    lines = store(spark, sf_dir).tables[COMPANIES].select(
        F.to_json(
            F.struct(F.array(*[F.lit(c) for c in fields]).alias("fields"), F.array(row).alias("data"))
        ).alias("value")
    )
    lines.write.mode("overwrite").text(path)
    return read_exchange_table(spark, path, whole_files=False)


def _filings(spark, sf_dir):
    """Every raw document as a filing of two items, written as JSON lines and read back."""
    path = f"{work_folder(spark, sf_dir)}/filings"
    year = F.lit(2019) - F.pmod("doc_id", F.lit(3))
    lines = raw(spark, sf_dir, "documents").select(
        F.concat("doc_id", F.lit("_"), year, F.lit(".json")).alias("filename"),
        F.col("lang").alias("section_1A"),
        F.col("text").alias("section_7"),
        F.col("source").alias("publisher"),
    )
    lines.write.mode("overwrite").json(path)
    return read_filing_lines(spark, path)


@query(
    "filing_sections",
    """
    SELECT key || '_' || n AS section_id, key AS doc_id, n AS section_no,
           CASE n WHEN 1 THEN 'Risk Factors' ELSE 'MD&A' END AS section_name,
           CASE n WHEN 1 THEN lang ELSE text END AS section_text
    FROM (SELECT doc_id || '_' || (2019 - doc_id % 3) AS key, lang, text, unnest([1, 2]) AS n FROM documents)
    """,
)
def sections_of_filings(spark, sf_dir):
    return filing_sections(_filings(spark, sf_dir))


@query(
    "filing_documents",
    """
    SELECT doc_id || '_' || (2019 - doc_id % 3) AS doc_id, CAST(doc_id AS VARCHAR) AS cik,
           doc_id || '_' || (2019 - doc_id % 3) || '.json' AS filename, 2019 - doc_id % 3 AS year,
           2 AS total_sections, length(lang) + length(text) AS total_chars
    FROM documents
    """,
)
def documents_of_filings(spark, sf_dir):
    return filing_documents(_filings(spark, sf_dir)).drop("file_path", "ingested_at", "processor_version")


def _mixed_filings(spark, sf_dir):
    """Every raw document in one of three layouts, or in one that cannot be read, as its id decides."""
    path = f"{work_folder(spark, sf_dir)}/mixed_filings"
    name = F.concat("doc_id", F.lit("_2019.json")).alias("filename")
    object_of = lambda *columns: F.to_json(F.struct(name, *columns))
    sections = F.create_map(F.lit("1A"), "lang", F.lit("7"), "text").alias("sections")
    entry = lambda item, text: F.struct(F.lit(item).alias("item"), F.col(text).alias("text"))
    told = F.to_json(F.struct(F.col("doc_id").alias("cik"), F.lit("2019").alias("year"), sections))
    kinds = (
        object_of(F.col("lang").alias("section_1A"), F.col("text").alias("section_7"), F.array("doc_id").alias("more")),
        object_of(sections),
        object_of(F.array(entry("1A", "lang"), entry("7", "text"), entry("7", "lang")).alias("items")),
        told,
        object_of(F.col("source").alias("publisher")),
        F.concat(F.lit("{broken "), "doc_id"),
        F.to_json(F.array("doc_id")),
        F.to_json(F.struct(sections)),
    )
    chosen = F.element_at(F.array(*kinds), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))
    raw(spark, sf_dir, "documents").select(chosen.alias("value")).write.mode("overwrite").text(path)
    return read_mixed_lines(spark, path)


@query(
    "mixed_filing_sections",
    """
    SELECT key || '_' || n AS section_id, key AS doc_id, n AS section_no,
           CASE n WHEN 1 THEN 'Risk Factors' ELSE 'MD&A' END AS section_name,
           CASE n WHEN 1 THEN lang ELSE text END AS section_text
    FROM (SELECT doc_id || '_2019' AS key, lang, text, unnest([1, 2]) AS n FROM documents WHERE doc_id % 8 < 4)
    """,
)
def mixed_filing_sections(spark, sf_dir):
    return filing_sections(_mixed_filings(spark, sf_dir)[0])


@query(
    "mixed_filing_rejects",
    """
    SELECT CASE doc_id % 8 WHEN 4 THEN 'no sections' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'not an object'
                ELSE 'no cik or year' END AS reason, count(*) AS files
    FROM documents WHERE doc_id % 8 >= 4 GROUP BY ALL
    """,
)
def mixed_filing_rejects(spark, sf_dir):
    return _mixed_filings(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("files"))


@query(
    "published_results",
    fts_sql(LABEL_REQUESTS.replace("'label ' || label AS query", "'the license' AS query")),
)
def published_results(spark, sf_dir):
    """Search results, published as a version, read through the pointer after a failed later write."""
    folder = f"{work_folder(spark, sf_dir)}/published-{uuid.uuid4().hex}"
    asked = label_requests(spark, sf_dir).withColumn("query", F.lit("the license"))
    found = bm25_search(asked, store(spark, sf_dir))
    publish(found.limit(3), folder)
    publish(found, folder)
    try:
        publish(found.limit(1), folder, rows=2)
    except ValueError:
        remove_old(spark, folder, keep=1)
    return read_published(spark, folder)
