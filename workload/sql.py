"""SQL building blocks: the logical tables and searches as common table expressions.

The rules are restated here from the table descriptions, independently of the Spark code.
"""

from __future__ import annotations

_TOKENS = "string_split_regex(strip_accents(lower({})), '[^a-z]+')"

# name -> (names it needs, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "t_companies": (
        (),
        """
        SELECT CAST(n_nationkey AS BIGINT) AS cik, n_name AS name,
               'TK' || n_nationkey AS ticker, r_name AS exchange
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(n_nationkey AS BIGINT), n_name, 'TK' || n_nationkey || 'B', r_name
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0
        """,
    ),
    "t_tickers": (
        (),
        """
        SELECT n_nationkey AS index_key, CAST(n_nationkey AS BIGINT) AS cik,
               'TK' || n_nationkey AS ticker, n_name AS title
        FROM nation
        """,
    ),
    "t_sections": (
        (),
        """
        SELECT doc_id || '_' || section_no AS section_id, doc_id, section_no,
               CASE section_no % 4 WHEN 0 THEN 'Business' WHEN 1 THEN 'Risk Factors'
                                   WHEN 2 THEN 'MD&A' ELSE 'Financial Statements' END AS section_name,
               section_text
        FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id,
                     unnest(string_split(text, chr(10))) AS section_text,
                     generate_subscripts(string_split(text, chr(10)), 1) AS section_no
              FROM documents)
        WHERE trim(section_text) <> ''
        """,
    ),
    "t_chunks": (
        ("t_sections",),
        """
        SELECT section_id || '_' || chunk_no AS chunk_id, section_id, doc_id,
               substr(section_text, chunk_no * 800 + 1, 800) AS chunk_text,
               length(substr(section_text, chunk_no * 800 + 1, 800)) AS char_count
        FROM (SELECT *, unnest(range(0, (length(section_text) - 1) // 800 + 1)) AS chunk_no
              FROM t_sections)
        """,
    ),
    "t_documents": (
        ("t_sections",),
        """
        SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, substr(source, 4) AS cik,
               substr(source, 4) || '_' || (2019 - d.doc_id % 3) || '_' || d.doc_id || '.json' AS filename,
               2019 - d.doc_id % 3 AS year,
               'data/' || substr(source, 4) || '_' || (2019 - d.doc_id % 3) || '_' || d.doc_id || '.json'
                   AS file_path,
               coalesce(t.total_sections, 0) AS total_sections,
               CAST(coalesce(t.total_chars, 0) AS BIGINT) AS total_chars,
               TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS ingested_at,
               'v1' AS processor_version
        FROM documents d
        LEFT JOIN (SELECT doc_id, count(*) AS total_sections, sum(length(section_text)) AS total_chars
                   FROM t_sections GROUP BY doc_id) t ON t.doc_id = CAST(d.doc_id AS VARCHAR)
        """,
    ),
    "t_vectors": (
        ("t_sections",),
        """
        SELECT f.chunk_id, CAST(e.embedding AS DOUBLE[]) AS embedding
        FROM embeddings e
        JOIN (SELECT doc_id, arg_min(section_id, section_no) || '_0' AS chunk_id
              FROM t_sections GROUP BY doc_id) f ON f.doc_id = CAST(e.vec_id AS VARCHAR)
        """,
    ),
    "t_tokens": (
        ("t_chunks",),
        f"""
        SELECT * FROM (SELECT chunk_id, unnest({_TOKENS.format('chunk_text')}) AS term FROM t_chunks)
        WHERE term <> ''
        """,
    ),
    "t_tf": (
        ("t_tokens",),
        "SELECT chunk_id, term, count(*) AS tf FROM t_tokens GROUP BY chunk_id, term",
    ),
    "t_dl": (("t_tokens",), "SELECT chunk_id, count(*) AS dl FROM t_tokens GROUP BY chunk_id"),
    "t_df": (
        ("t_tf",),
        "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t_tf GROUP BY term",
    ),
    "t_corpus": (
        ("t_chunks", "t_dl", "t_tf"),
        """
        SELECT (SELECT count(*) FROM t_chunks) AS n_chunks, (SELECT avg(dl) FROM t_dl) AS avgdl,
               (SELECT count(*) FROM t_tf) AS n_postings
        """,
    ),
    "t_names": (
        ("t_companies",),
        "SELECT CAST(cik AS VARCHAR) AS cik, min(name) AS company_name FROM t_companies GROUP BY cik",
    ),
    "t_labels": (
        ("t_chunks", "t_sections", "t_documents", "t_names"),
        """
        SELECT c.chunk_id, c.section_id, d.doc_id, d.cik, n.company_name, d.filename, d.year,
               s.section_name, c.chunk_text, CAST(c.char_count AS BIGINT) AS char_count
        FROM t_chunks c JOIN t_sections s ON c.section_id = s.section_id
        JOIN t_documents d ON c.doc_id = d.doc_id LEFT JOIN t_names n ON n.cik = d.cik
        """,
    ),
    "q_ciks": (
        ("req", "t_companies"),
        """
        SELECT DISTINCT r.request_id, CAST(c.cik AS VARCHAR) AS cik
        FROM (SELECT request_id, upper(unnest(tickers)) AS ticker FROM req) r
        JOIN t_companies c ON upper(c.ticker) = r.ticker
        """,
    ),
    "q_terms": (
        ("req",),
        f"""
        SELECT DISTINCT request_id, term
        FROM (SELECT request_id, unnest({_TOKENS.format('query')}) AS term FROM req) WHERE term <> ''
        """,
    ),
    "q_scored": (
        ("q_terms", "t_tf", "t_df", "t_dl", "t_corpus"),
        """
        SELECT q.request_id, t.chunk_id,
               sum(log10((n_chunks - df + 0.5) / (df + 0.5) + 1)
                   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS fts_score
        FROM q_terms q JOIN t_tf t ON t.term = q.term JOIN t_df f ON f.term = q.term
        JOIN t_dl l ON l.chunk_id = t.chunk_id, t_corpus
        GROUP BY q.request_id, t.chunk_id
        """,
    ),
    "q_distances": (
        ("req", "t_vectors"),
        """
        SELECT r.request_id, v.chunk_id, list_cosine_distance(v.embedding, r.query_vec) AS distance
        FROM req r, t_vectors v WHERE r.query_vec IS NOT NULL
        """,
    ),
}

_ALLOWED = """
    (coalesce(len(r.tickers), 0) = 0
     OR EXISTS (SELECT 1 FROM q_ciks k WHERE k.request_id = r.request_id AND k.cik = l.cik))
    AND (coalesce(len(r.ciks), 0) = 0 OR list_contains(r.ciks, l.cik))
"""


def _keyword_hits(limit: str, threshold: str, extra: str = "") -> str:
    return f"""
        SELECT s.request_id, s.chunk_id, s.fts_score,
               row_number() OVER (PARTITION BY s.request_id
                                  ORDER BY round(s.fts_score, 9) DESC, s.chunk_id) AS rank
        FROM q_scored s JOIN t_labels l ON l.chunk_id = s.chunk_id
        JOIN req r ON r.request_id = s.request_id
        WHERE {_ALLOWED} {threshold} {extra}
        QUALIFY rank <= {limit}
    """


def _vector_hits(limit: str, threshold: str, extra: str = "") -> str:
    return f"""
        SELECT s.request_id, s.chunk_id, s.distance, greatest(0.0, 1.0 - s.distance) AS vector_score,
               row_number() OVER (PARTITION BY s.request_id
                                  ORDER BY round(s.distance, 9), s.chunk_id) AS rank
        FROM q_distances s JOIN t_labels l ON l.chunk_id = s.chunk_id
        JOIN req r ON r.request_id = s.request_id
        WHERE NOT isnan(s.distance) AND {_ALLOWED} {threshold} {extra}
        QUALIFY rank <= {limit}
    """


_HYBRID_NEEDS = ("q_scored", "q_distances", "t_labels", "q_ciks")
_WIDE = "least(3 * r.lim, 100)"

_CTES |= {
    "fts_hits": (
        ("q_scored", "t_labels", "q_ciks"),
        _keyword_hits("r.lim", "AND (coalesce(r.min_score, 0) = 0 OR s.fts_score >= r.min_score)"),
    ),
    "vector_hits": (
        ("q_distances", "t_labels", "q_ciks"),
        _vector_hits("r.lim", "AND (coalesce(r.max_distance, 0) = 0 OR s.distance <= r.max_distance)"),
    ),
    "substring_hits": (
        ("t_labels", "q_ciks"),
        f"""
        SELECT r.request_id, l.chunk_id,
               row_number() OVER (PARTITION BY r.request_id ORDER BY l.chunk_id) AS rank
        FROM req r JOIN t_labels l ON l.chunk_text ILIKE '%' || r.query || '%'
        WHERE {_ALLOWED}
        QUALIFY rank <= r.lim
        """,
    ),
    "wide_fts": (_HYBRID_NEEDS, _keyword_hits(_WIDE, "", "AND r.fts_weight > 0")),
    "wide_vector": (_HYBRID_NEEDS, _vector_hits(_WIDE, "", "AND r.semantic_weight > 0")),
    "fused": (
        ("wide_fts", "wide_vector", "req"),
        """
        SELECT request_id, chunk_id, f, v, distance, fts_rank, vector_rank, r.lim,
               f * (r.fts_weight / (r.fts_weight + r.semantic_weight))
               + v * (r.semantic_weight / (r.fts_weight + r.semantic_weight)) AS combined_score,
               count(fts_rank) OVER w AS fts_results, count(vector_rank) OVER w AS vector_results,
               count(*) OVER w AS combined_unique
        FROM (SELECT coalesce(a.request_id, b.request_id) AS request_id,
                     coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
                     coalesce(a.f, 0.0) AS f, coalesce(b.v, 0.0) AS v, b.distance,
                     a.rank AS fts_rank, b.rank AS vector_rank
              FROM (SELECT h.*, CASE WHEN r.normalize_scores THEN h.fts_score /
                           CASE WHEN max(h.fts_score) OVER (PARTITION BY h.request_id) > 0
                                THEN max(h.fts_score) OVER (PARTITION BY h.request_id) ELSE 1.0 END
                           ELSE h.fts_score END AS f
                    FROM wide_fts h JOIN req r ON r.request_id = h.request_id) a
              FULL JOIN
                   (SELECT h.*, CASE WHEN r.normalize_scores THEN h.vector_score /
                           CASE WHEN max(h.vector_score) OVER (PARTITION BY h.request_id) > 0
                                THEN max(h.vector_score) OVER (PARTITION BY h.request_id) ELSE 1.0 END
                           ELSE h.vector_score END AS v
                    FROM wide_vector h JOIN req r ON r.request_id = h.request_id) b
              ON a.request_id = b.request_id AND a.chunk_id = b.chunk_id)
        JOIN req r USING (request_id)
        WINDOW w AS (PARTITION BY request_id)
        """,
    ),
    "hybrid_hits": (
        ("fused",),
        """
        SELECT request_id, chunk_id, f AS fts_score, v AS vector_score, distance, combined_score,
               fts_results, vector_results, combined_unique,
               row_number() OVER (PARTITION BY request_id
                                  ORDER BY round(combined_score, 9) DESC, fts_rank NULLS LAST,
                                           vector_rank NULLS LAST, chunk_id) AS rank
        FROM fused QUALIFY rank <= lim
        """,
    ),
}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def request_cte(rows: list[dict]) -> str:
    """Request mappings, vectors given as ``vec_id``, as the body of the ``req`` expression."""

    def select(row: dict) -> str:
        def value(name: str, kind: str, default=None) -> str:
            given = row.get(name)
            return f"CAST({_literal(default if given is None else given)} AS {kind})"

        vec_id = row.get("vec_id")
        vector = "NULL" if vec_id is None else f"(SELECT embedding FROM embeddings WHERE vec_id = {vec_id})"
        return f"""
            SELECT {value('request_id', 'VARCHAR')} AS request_id, {value('query', 'VARCHAR')} AS query,
                   {value('limit', 'BIGINT', 10)} AS lim,
                   {value('tickers', 'VARCHAR[]')} AS tickers, {value('ciks', 'VARCHAR[]')} AS ciks,
                   {value('min_score', 'DOUBLE')} AS min_score,
                   {value('include_distances', 'BOOLEAN', True)} AS include_distances,
                   {value('max_distance', 'DOUBLE')} AS max_distance,
                   {value('fts_weight', 'DOUBLE', 0.3)} AS fts_weight,
                   {value('semantic_weight', 'DOUBLE', 0.7)} AS semantic_weight,
                   {value('normalize_scores', 'BOOLEAN', True)} AS normalize_scores,
                   CAST({vector} AS DOUBLE[]) AS query_vec
        """

    return " UNION ALL ".join(select(row) for row in rows)


# Requests taken from the data: every benchmark passage, whole, as a query; and the rounded mean
# vector of every label.
BENCHMARK_REQUESTS = """
    SELECT 'b' || item_id AS request_id, text AS query, 5 AS lim,
           CAST(NULL AS VARCHAR[]) AS tickers, CAST(NULL AS VARCHAR[]) AS ciks,
           CAST(NULL AS DOUBLE) AS min_score, TRUE AS include_distances,
           CAST(NULL AS DOUBLE) AS max_distance, 0.3 AS fts_weight, 0.7 AS semantic_weight,
           TRUE AS normalize_scores, CAST(NULL AS DOUBLE[]) AS query_vec
    FROM benchmark
"""
# The same passages with the vector of their number.
PAIRED_REQUESTS = BENCHMARK_REQUESTS.replace(
    "CAST(NULL AS DOUBLE[]) AS query_vec",
    "CAST((SELECT e.embedding FROM embeddings e WHERE e.vec_id = item_id) AS DOUBLE[]) AS query_vec",
)
LABEL_REQUESTS = """
    SELECT 'label' || label AS request_id, 'label ' || label AS query, 10 AS lim,
           CAST(NULL AS VARCHAR[]) AS tickers, CAST(NULL AS VARCHAR[]) AS ciks,
           CAST(NULL AS DOUBLE) AS min_score, TRUE AS include_distances,
           CAST(NULL AS DOUBLE) AS max_distance, 0.3 AS fts_weight, 0.7 AS semantic_weight,
           TRUE AS normalize_scores,
           CAST(CAST(list(mean ORDER BY pos) AS FLOAT[]) AS DOUBLE[]) AS query_vec
    FROM (SELECT label, pos, round(avg(x), 4) AS mean
          FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                       generate_subscripts(embedding, 1) AS pos FROM embeddings)
          GROUP BY label, pos)
    GROUP BY label
"""


def with_ctes(body: str, *needs: str, req: str | None = None) -> str:
    """``body`` preceded by the expressions it needs, each after those it builds on."""
    ctes = dict(_CTES)
    if req is not None:
        ctes["req"] = ((), req)
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in ctes[name][0]:
                add(needed)
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{n} AS ({ctes[n][1]})" for n in ordered) + " " + body


def rounded(expression: str, alias: str, digits: int = 6) -> str:
    """Adding 0 turns a negative zero into zero."""
    return f"round({expression}, {digits}) + 0.0 AS {alias}"


def result_select(hits: str, method: str, scores: dict[str, str], extra: str = "") -> str:
    """Labelled hits in the shape of a result table."""
    columns = ", ".join(
        rounded(scores[name], name) if name in scores else f"CAST(NULL AS DOUBLE) AS {name}"
        for name in ("fts_score", "vector_score", "distance", "combined_score")
    )
    return f"""
        SELECT h.request_id, h.rank, '{method}' AS method, h.chunk_id, l.doc_id, l.cik, l.company_name,
               l.filename, l.section_name, l.chunk_text, l.char_count, {columns} {extra}
        FROM {hits} h JOIN t_labels l ON l.chunk_id = h.chunk_id JOIN req r ON r.request_id = h.request_id
    """


FTS_SCORES = {"fts_score": "h.fts_score"}
VECTOR_SCORES = {
    "vector_score": "h.vector_score",
    "distance": "CASE WHEN r.include_distances THEN h.distance END",
}
HYBRID_SCORES = {
    "fts_score": "h.fts_score",
    "vector_score": "h.vector_score",
    "distance": "h.distance",
    "combined_score": "h.combined_score",
}


def fts_sql(req: str) -> str:
    return with_ctes(result_select("fts_hits", "fts", FTS_SCORES), "fts_hits", "req", req=req)


def substring_sql(req: str) -> str:
    return with_ctes(result_select("substring_hits", "fts", {}), "req", "substring_hits", req=req)


def vector_sql(req: str) -> str:
    return with_ctes(result_select("vector_hits", "vector", VECTOR_SCORES), "vector_hits", "req", req=req)


def hybrid_sql(req: str) -> str:
    return with_ctes(result_select("hybrid_hits", "hybrid", HYBRID_SCORES), "hybrid_hits", "req", req=req)
