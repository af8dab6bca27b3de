"""Scans, projections, filters, joins, counts and derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import contains_ci, excerpt, plain_list, upper_list
from gleaner.functions.vectors import cosine_distance, norm, similarity
from gleaner.operators import lookup
from gleaner.operators.derive import document_totals
from gleaner.operators.lookup_batch import find_companies_batch, find_documents_batch
from gleaner.operators.ranking import company_names
from gleaner.operators.requests import clamp_limit, complement_weights, split_requests, with_defaults
from gleaner.operators.stats import capabilities, is_empty, table_counts
from gleaner.plans.store import corpus_stats, forward_rows, posting_rows, term_stats
from gleaner.schemas import CHUNKS, COMPANIES, DOCUMENTS, EMBEDDINGS, SECTIONS, TICKERS
from gleaner.sources.raw import raw
from gleaner.sources.tables import catalog_tables, missing_tables, register_views, table_inventory
from workload.registry import ORACLES, query, requests_for, store
from workload.sql import rounded, with_ctes


def _tables(spark, sf_dir):
    return store(spark, sf_dir).tables


_DOC_COLUMNS = """
    doc_id, cik, filename, year, file_path, total_sections, total_chars,
    CAST(ingested_at AS VARCHAR) AS ingested_at, processor_version
"""



def _lookup_tables(spark, sf_dir):
    """The logical tables, with document metadata as the store keeps it: without text."""
    opened = store(spark, sf_dir)
    return {**opened.tables, DOCUMENTS: opened.documents()}


# -- scans ----------------------------------------------------------------------------------------


@query(
    "scan_companies",
    with_ctes("SELECT cik, name, ticker, exchange FROM t_companies", "t_companies"),
)
def scan_companies(spark, sf_dir):
    return _tables(spark, sf_dir)[COMPANIES]


@query("scan_tickers", with_ctes("SELECT index_key, cik, ticker, title FROM t_tickers", "t_tickers"))
def scan_tickers(spark, sf_dir):
    return _tables(spark, sf_dir)[TICKERS]


@query("scan_documents", with_ctes(f"SELECT {_DOC_COLUMNS} FROM t_documents", "t_documents"))
def scan_documents(spark, sf_dir):
    return _tables(spark, sf_dir)[DOCUMENTS].withColumn("ingested_at", F.col("ingested_at").cast("string"))


@query(
    "scan_sections",
    with_ctes(
        "SELECT section_id, doc_id, section_no, section_name, section_text FROM t_sections", "t_sections"
    ),
)
def scan_sections(spark, sf_dir):
    return _tables(spark, sf_dir)[SECTIONS]


@query(
    "scan_chunks",
    with_ctes("SELECT chunk_id, section_id, doc_id, chunk_text, char_count FROM t_chunks", "t_chunks"),
)
def scan_chunks(spark, sf_dir):
    return _tables(spark, sf_dir)[CHUNKS]


@query(
    "scan_embeddings",
    with_ctes(
        f"""
        SELECT chunk_id, len(embedding) AS dims,
               {rounded('sqrt(list_dot_product(embedding, embedding))', 'norm')},
               {rounded('embedding[1]', 'first_value')}
        FROM t_vectors
        """,
        "t_vectors",
    ),
)
def scan_embeddings(spark, sf_dir):
    vector = F.col("embedding")
    return _tables(spark, sf_dir)[EMBEDDINGS].select(
        "chunk_id",
        F.size(vector).alias("dims"),
        norm(vector).alias("norm"),
        F.get(vector, F.lit(0)).alias("first_value"),
    )


@query(
    "table_inventory",
    with_ctes(
        """
        SELECT 'company_tickers_exchange' AS table_name, TRUE AS present, count(*) AS row_count FROM t_companies
        UNION ALL SELECT 'company_tickers', TRUE, count(*) FROM t_tickers
        UNION ALL SELECT 'documents', TRUE, count(*) FROM t_documents
        UNION ALL SELECT 'sections', TRUE, count(*) FROM t_sections
        UNION ALL SELECT 'chunks', TRUE, count(*) FROM t_chunks
        UNION ALL SELECT 'embeddings', TRUE, count(*) FROM t_vectors
        """,
        "t_companies",
        "t_tickers",
        "t_documents",
        "t_sections",
        "t_chunks",
        "t_vectors",
    ),
)
def inventory(spark, sf_dir):
    return table_inventory(spark, _tables(spark, sf_dir))


_INVENTORY = ORACLES["table_inventory"]


@query("catalog_inventory", _INVENTORY)
def catalog_inventory(spark, sf_dir):
    """The same through names of the session catalog, none of which may be missing."""
    tables = _tables(spark, sf_dir)
    register_views(tables)
    try:
        if missing_tables(spark).count():
            raise RuntimeError("a registered table is missing from the catalog")
        return table_inventory(spark, catalog_tables(spark))
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


@query("tables_empty", f"SELECT table_name, row_count = 0 AS is_empty FROM ({_INVENTORY})")
def tables_empty(spark, sf_dir):
    found = [(name, is_empty(frame)) for name, frame in _tables(spark, sf_dir).items()]
    return spark.createDataFrame(found, "table_name string, is_empty boolean")


@query(
    "lookup_without_filter",
    with_ctes(
        "SELECT count(*) AS listings, 'at least one search parameter must be provided' AS reason FROM t_companies",
        "t_companies",
    ),
)
def lookup_without_filter(spark, sf_dir):
    """A lookup that names nothing is refused, however many listings there are."""
    listings = _tables(spark, sf_dir)[COMPANIES]
    try:
        return lookup.find_companies(listings)
    except ValueError as refused:
        return listings.agg(F.count(F.lit(1)).alias("listings")).withColumn("reason", F.lit(str(refused)))


# -- projections ----------------------------------------------------------------------------------


@query(
    "section_lengths",
    with_ctes(
        "SELECT section_id, section_name, length(section_text) AS content_length FROM t_sections",
        "t_sections",
    ),
)
def section_lengths(spark, sf_dir):
    return _tables(spark, sf_dir)[SECTIONS].select(
        "section_id", "section_name", F.length("section_text").alias("content_length")
    )


@query(
    "chunk_excerpts",
    with_ctes("SELECT chunk_id, substr(chunk_text, 1, 300) || '...' AS excerpt FROM t_chunks", "t_chunks"),
)
def chunk_excerpts(spark, sf_dir):
    return _tables(spark, sf_dir)[CHUNKS].select("chunk_id", excerpt(F.col("chunk_text")).alias("excerpt"))


_VEC_0 = [{"request_id": "v0", "query": "vector 0", "vec_id": 0}]


@query(
    "similarity_of_all_vectors",
    with_ctes(
        f"""
        SELECT chunk_id, {rounded('distance', 'distance')},
               {rounded('greatest(0.0, 1.0 - distance)', 'vector_score')}
        FROM (SELECT chunk_id,
                     list_cosine_distance(embedding, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings
                                                      WHERE vec_id = 0)) AS distance
              FROM t_vectors)
        """,
        "t_vectors",
    ),
)
def similarity_of_all_vectors(spark, sf_dir):
    """The distance as a column expression, the check on the block product the search uses."""
    vector = requests_for(spark, sf_dir, _VEC_0).first()["query_vec"]
    distance = cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in vector]))
    return (
        _tables(spark, sf_dir)[EMBEDDINGS]
        .select("chunk_id", distance.alias("distance"))
        .withColumn("vector_score", similarity(F.col("distance")))
    )


@query(
    "comma_lists",
    """
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)),
                                               lambda x: x <> ''), '|') AS plain,
           array_to_string(list_filter(list_transform(string_split(csv, ','), lambda x: upper(trim(x))),
                                       lambda x: x <> ''), '|') AS upper_case
    FROM (SELECT doc_id, ' ' || source || ' ,, ' || lang || ', ,x' || n_chars AS csv FROM documents)
    """,
)
def comma_lists(spark, sf_dir):
    csv = F.concat(F.lit(" "), "source", F.lit(" ,, "), "lang", F.lit(", ,x"), "n_chars")
    return raw(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(plain_list(csv), "|").alias("plain"),
        F.array_join(upper_list(csv), "|").alias("upper_case"),
    )


# -- company lookups ------------------------------------------------------------------------------


def _company_sql(where: str, limit: int = 50) -> str:
    return with_ctes(
        f"""
        SELECT cik, name, ticker, exchange FROM t_companies WHERE {where}
        ORDER BY name NULLS LAST, ticker NULLS LAST LIMIT {limit}
        """,
        "t_companies",
    )


def _company_query(key: str, where: str, limit: int = 50, /, **given):
    @query(key, _company_sql(where, limit))
    def build(spark, sf_dir):
        return lookup.find_companies(_tables(spark, sf_dir)[COMPANIES], limit=limit, **given)


_company_query("companies_name_contains", "upper(name) LIKE upper('%nation_1%')", name="nation_1")
_company_query("companies_ticker_contains", "upper(ticker) LIKE upper('%tk1%')", ticker="tk1")
_company_query("companies_cik_equals", "cik = 10", cik=10)
_company_query("companies_exchange_equals", "upper(exchange) = upper('asia')", exchange="asia")
_company_query(
    "companies_all_filters",
    "upper(name) LIKE upper('%NATION%') AND upper(ticker) LIKE upper('%tk15b%') "
    "AND cik = 15 AND upper(exchange) = upper('Africa')",
    name="NATION",
    ticker="tk15b",
    cik=15,
    exchange="Africa",
)
_company_query("companies_wildcard_name", "upper(name) LIKE upper('%n%_1_%')", name="n%_1_")
_company_query("companies_top_3", "upper(name) LIKE upper('%nation%')", 3, name="nation")


# Every listing asks for itself in several ways: part of its name, wildcards, its ticker, all filters, nothing.
_COMPANY_REQUESTS = """
    SELECT kind || ticker || '/' || cik AS request_id, wanted_name, wanted_ticker, wanted_cik, wanted_exchange, lim FROM (
        SELECT ticker, cik, unnest(['n', 'w', 't', 'a', 'e', '-', 'l']) AS kind,
               CASE WHEN kind IN ('n', 'a') THEN substr(name, 3, 6) WHEN kind = 'w' THEN substr(name, 1, 2) || '%' || right(name, 2) || '_' END AS wanted_name,
               CASE WHEN kind IN ('t', 'a') THEN substr(lower(ticker), 2) WHEN kind = 'w' THEN '_' END AS wanted_ticker,
               CASE WHEN kind = 'a' THEN cik WHEN kind = '-' THEN 0 END AS wanted_cik,
               CASE WHEN kind IN ('e', 'a', 'l') THEN lower(exchange) WHEN kind = '-' THEN '' END AS wanted_exchange,
               CASE WHEN kind = 'l' THEN 1001 ELSE 5 END AS lim
        FROM t_companies)
"""


def company_requests(companies):
    """``_COMPANY_REQUESTS`` as a frame."""
    kind = F.col("kind")
    asked = companies.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in "nwtae-l"])))
    wild = F.concat(F.substring("name", 1, 2), F.lit("%"), F.right("name", F.lit(2)), F.lit("_"))
    return asked.select(
        F.concat("kind", "ticker", F.lit("/"), "cik").alias("request_id"),
        F.when(kind.isin("n", "a"), F.substring("name", 3, 6)).when(kind == "w", wild).alias("name"),
        F.when(kind.isin("t", "a"), F.expr("substr(lower(ticker), 2)")).when(kind == "w", F.lit("_")).alias("ticker"),
        F.when(kind == "a", F.col("cik")).when(kind == "-", F.lit(0)).cast("long").alias("cik"),
        F.when(kind.isin("e", "a", "l"), F.lower("exchange")).when(kind == "-", F.lit("")).alias("exchange"),
        F.when(kind == "l", F.lit(1001)).otherwise(F.lit(5)).alias("limit"),
    )


_COMPANY_VALID = """
    (wanted_name <> '' OR wanted_ticker <> '' OR wanted_cik <> 0 OR wanted_exchange <> '') IS TRUE AND lim BETWEEN 1 AND 1000
"""


@query(
    "companies_batch",
    with_ctes(
        f"""
        SELECT request_id, rank, cik, name, ticker, exchange FROM (
            SELECT r.request_id, r.lim, c.*, row_number() OVER (PARTITION BY r.request_id
                       ORDER BY name NULLS LAST, ticker NULLS LAST, cik NULLS LAST, exchange NULLS LAST) AS rank
            FROM (SELECT * FROM ({_COMPANY_REQUESTS}) WHERE {_COMPANY_VALID}) r JOIN t_companies c
              ON (coalesce(wanted_name, '') = '' OR upper(name) LIKE '%' || upper(wanted_name) || '%')
             AND (coalesce(wanted_ticker, '') = '' OR upper(ticker) LIKE '%' || upper(wanted_ticker) || '%')
             AND (coalesce(wanted_cik, 0) = 0 OR cik = wanted_cik)
             AND (coalesce(wanted_exchange, '') = '' OR upper(exchange) = upper(wanted_exchange)))
        WHERE rank <= lim
        """,
        "t_companies",
    ),
)
def companies_batch(spark, sf_dir):
    companies = _tables(spark, sf_dir)[COMPANIES]
    return find_companies_batch(company_requests(companies), companies)[0]


@query(
    "companies_batch_rejected",
    with_ctes(
        f"""
        SELECT request_id, concat_ws('; ', CASE WHEN (wanted_name <> '' OR wanted_ticker <> '' OR wanted_cik <> 0
                   OR wanted_exchange <> '') IS NOT TRUE THEN 'no filter' END,
                   CASE WHEN lim NOT BETWEEN 1 AND 1000 THEN 'limit out of bounds' END) AS reason
        FROM ({_COMPANY_REQUESTS}) WHERE NOT ({_COMPANY_VALID})
        """,
        "t_companies",
    ),
)
def companies_batch_rejected(spark, sf_dir):
    companies = _tables(spark, sf_dir)[COMPANIES]
    return find_companies_batch(company_requests(companies), companies)[1].select("request_id", "reason")


@query("preset_companies_by_ticker", _company_sql("upper(ticker) LIKE upper('%tk2%')"))
def preset_companies_by_ticker(spark, sf_dir):
    return lookup.companies_by_ticker(_tables(spark, sf_dir)[COMPANIES], "tk2")


@query("preset_companies_by_name", _company_sql("upper(name) LIKE upper('%_2%')"))
def preset_companies_by_name(spark, sf_dir):
    return lookup.companies_by_name(_tables(spark, sf_dir)[COMPANIES], "_2")


@query("preset_company_by_cik", _company_sql("cik = 20", 1))
def preset_company_by_cik(spark, sf_dir):
    return lookup.company_by_cik(_tables(spark, sf_dir)[COMPANIES], 20)


# -- document lookups -----------------------------------------------------------------------------


def _document_sql(where: str, limit: int = 50) -> str:
    return with_ctes(
        f"""
        SELECT {_DOC_COLUMNS} FROM t_documents d WHERE {where}
        ORDER BY d.cik NULLS LAST, d.year DESC NULLS LAST, d.filename NULLS LAST LIMIT {limit}
        """,
        "t_documents",
        "t_companies",
    )


def _ticker_sql(*tickers: str) -> str:
    listed = ", ".join(f"'{t.upper()}'" for t in tickers)
    return f"d.cik IN (SELECT CAST(cik AS VARCHAR) FROM t_companies WHERE upper(ticker) IN ({listed}))"


def _document_query(key: str, where: str, limit: int = 50, /, **given):
    @query(key, _document_sql(where, limit))
    def build(spark, sf_dir):
        return lookup.find_documents(_lookup_tables(spark, sf_dir), limit=limit, **given)


_document_query(
    "documents_by_tickers", _ticker_sql("tk0", "tk0b", "nope"), tickers="tk0, TK0B ,, NOPE"
)
_document_query("documents_by_ciks", "d.cik IN ('3', '11')", 1000, ciks=" 3,11 ,")
_document_query("documents_by_year", "d.year = 2018", year=2018)
_document_query("documents_unresolved_ticker", _ticker_sql("nope"), tickers="NOPE")
_document_query(
    "documents_all_filters",
    _ticker_sql("tk3", "tk4") + " AND d.cik IN ('4', '5') AND d.year = 2019",
    tickers="tk3,tk4",
    ciks="4,5",
    year=2019,
)
# Every listing asks for the documents of its ticker, of its cik, of both, and of a year.
_DOCUMENT_REQUESTS = """
    SELECT kind || ticker || '/' || cik AS request_id, lim, tick, ck, yr FROM (
        SELECT ticker, cik, unnest(['t', 'c', 'b', 'y', '-']) AS kind,
               CASE WHEN kind IN ('t', 'b') THEN [lower(ticker), 'NOPE'] WHEN kind = '-' THEN [''] END AS tick,
               CASE WHEN kind IN ('c', 'b') THEN [CAST(cik AS VARCHAR), CAST(cik + 1 AS VARCHAR)] END AS ck,
               CASE WHEN kind IN ('c', 'y') THEN 2015 + cik % 6 WHEN kind = '-' THEN 0 END AS yr, 7 AS lim
        FROM t_companies)
"""


def document_requests(companies):
    """``_DOCUMENT_REQUESTS`` as a frame."""
    kind = F.col("kind")
    asked = companies.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in "tcby-"])))
    ciks = F.array(F.col("cik").cast("string"), (F.col("cik") + 1).cast("string"))
    return asked.select(
        F.concat("kind", "ticker", F.lit("/"), "cik").alias("request_id"),
        F.when(kind.isin("t", "b"), F.array(F.lower("ticker"), F.lit("NOPE"))).when(kind == "-", F.array(F.lit(""))).alias("tickers"),
        F.when(kind.isin("c", "b"), ciks).alias("ciks"),
        F.when(kind.isin("c", "y"), F.lit(2015) + F.col("cik") % 6).when(kind == "-", F.lit(0)).cast("int").alias("year"),
        F.lit(7).alias("limit"),
    )


@query(
    "documents_batch",
    with_ctes(
        f"""
        SELECT request_id, rank, {_DOC_COLUMNS} FROM (
            SELECT r.request_id, r.lim, d.*, row_number() OVER (PARTITION BY r.request_id
                       ORDER BY d.cik NULLS LAST, d.year DESC NULLS LAST, d.filename NULLS LAST, d.doc_id) AS rank
            FROM (SELECT * FROM ({_DOCUMENT_REQUESTS}) WHERE tick <> [''] OR ck IS NOT NULL OR yr <> 0) r JOIN t_documents d
              ON (tick IS NULL OR EXISTS (SELECT 1 FROM t_companies c WHERE CAST(c.cik AS VARCHAR) = d.cik
                                          AND list_contains(list_transform(tick, lambda x: upper(x)), upper(c.ticker))))
             AND (ck IS NULL OR list_contains(ck, d.cik)) AND (coalesce(yr, 0) = 0 OR d.year = yr))
        WHERE rank <= lim
        """,
        "t_documents",
        "t_companies",
    ),
)
def documents_batch(spark, sf_dir):
    given = _lookup_tables(spark, sf_dir)
    return find_documents_batch(document_requests(given[COMPANIES]), given)[0]


_document_query("documents_year_zero_is_no_filter", "d.cik IN ('7')", 1000, ciks="7", year=0)


@query("document_by_id", with_ctes(f"SELECT {_DOC_COLUMNS} FROM t_documents WHERE doc_id = '7'", "t_documents"))
def document_by_id(spark, sf_dir):
    return lookup.get_document(_lookup_tables(spark, sf_dir)[DOCUMENTS], "7")


@query(
    "preset_documents_by_ticker", _document_sql(_ticker_sql("tk5b") + " AND d.year = 2017", 50)
)
def preset_documents_by_ticker(spark, sf_dir):
    return lookup.documents_by_ticker(_lookup_tables(spark, sf_dir), "TK5B", 2017)


@query("preset_documents_by_cik", _document_sql("d.cik = '12'"))
def preset_documents_by_cik(spark, sf_dir):
    return lookup.documents_by_cik(_lookup_tables(spark, sf_dir), "12")


@query("drilldown_companies", _company_sql("upper(ticker) LIKE upper('%tk1%')", 5))
def drilldown_companies(spark, sf_dir):
    return lookup.ticker_drilldown(_lookup_tables(spark, sf_dir), "tk1")[0]


@query("drilldown_documents", _document_sql(_ticker_sql("tk1") + " AND d.year = 2019", 5))
def drilldown_documents(spark, sf_dir):
    return lookup.ticker_drilldown(_lookup_tables(spark, sf_dir), "tk1")[1]


@query(
    "companies_with_documents",
    with_ctes(
        """
        SELECT cik, name, ticker, exchange FROM t_companies
        WHERE CAST(cik AS VARCHAR) IN (SELECT cik FROM t_documents)
        """,
        "t_companies",
        "t_documents",
    ),
)
def companies_with_documents(spark, sf_dir):
    return lookup.companies_with_documents(_lookup_tables(spark, sf_dir))


@query(
    "company_sections",
    with_ctes(
        """
        SELECT d.doc_id, d.filename, d.year, s.section_no, s.section_name, s.section_text
        FROM t_documents d JOIN t_sections s ON s.doc_id = d.doc_id WHERE d.cik = '3'
        """,
        "t_documents",
        "t_sections",
    ),
)
def company_sections(spark, sf_dir):
    return lookup.company_sections(_tables(spark, sf_dir), "3")


@query(
    "longest_sections",
    with_ctes(
        """
        SELECT n.company_name, s.section_id, s.section_name, length(s.section_text) AS content_length
        FROM t_sections s JOIN t_documents d ON d.doc_id = s.doc_id LEFT JOIN t_names n ON n.cik = d.cik
        ORDER BY content_length DESC, s.section_id LIMIT 10
        """,
        "t_sections",
        "t_documents",
        "t_names",
    ),
)
def longest_sections(spark, sf_dir):
    return lookup.longest_sections(_tables(spark, sf_dir))


@query(
    "browse_companies",
    with_ctes(
        """
        SELECT cik, name, ticker, exchange FROM t_companies
        ORDER BY cik NULLS FIRST, name NULLS FIRST, ticker NULLS FIRST, exchange NULLS FIRST LIMIT 10
        """,
        "t_companies",
    ),
)
def browse_companies(spark, sf_dir):
    return lookup.browse(_tables(spark, sf_dir)[COMPANIES])


# -- joins ----------------------------------------------------------------------------------------


@query(
    "chunk_labels",
    with_ctes(
        """
        SELECT chunk_id, section_id, doc_id, cik, filename, section_name, chunk_text, char_count
        FROM t_labels
        """,
        "t_labels",
    ),
)
def chunk_labels(spark, sf_dir):
    """Chunks joined to their section and document."""
    columns = "chunk_id section_id doc_id cik filename section_name chunk_text char_count".split()
    return store(spark, sf_dir).passages().where("linked").select(*columns)


@query(
    "chunk_vectors",
    with_ctes(
        f"""
        SELECT l.chunk_id, l.cik, l.section_id, len(v.embedding) AS dims,
               {rounded('sqrt(list_dot_product(v.embedding, v.embedding))', 'norm')}
        FROM t_labels l JOIN t_vectors v ON v.chunk_id = l.chunk_id
        """,
        "t_labels",
        "t_vectors",
    ),
)
def chunk_vectors(spark, sf_dir):
    """Chunks that have a vector, with its stored norm."""
    opened = store(spark, sf_dir)
    sections = opened.passages().select("chunk_id", "section_id")
    return (
        opened.vectors()
        .join(sections, "chunk_id")
        .select("chunk_id", "cik", "section_id", F.size("embedding").alias("dims"), "norm")
    )


@query(
    "documents_with_company_name",
    with_ctes(
        """
        SELECT d.doc_id, d.cik, n.company_name, coalesce(n.company_name, 'Unknown Company') AS label
        FROM t_documents d LEFT JOIN t_names n ON n.cik = d.cik
        """,
        "t_documents",
        "t_names",
    ),
)
def documents_with_company_name(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return (
        tables[DOCUMENTS]
        .select("doc_id", "cik")
        .join(company_names(tables[COMPANIES]), "cik", "left")
        .withColumn("label", F.coalesce("company_name", F.lit("Unknown Company")))
    )


@query(
    "ciks_of_tickers",
    with_ctes(
        "SELECT DISTINCT CAST(cik AS VARCHAR) AS cik FROM t_companies WHERE upper(ticker) IN ('TK0', 'TK0B', 'NOPE')",
        "t_companies",
    ),
)
def ciks_of_tickers(spark, sf_dir):
    return lookup.ciks_of_tickers(_tables(spark, sf_dir)[COMPANIES], ["tk0", "TK0B", "NOPE"])


# -- counts ---------------------------------------------------------------------------------------

_ALL = ("t_companies", "t_tickers", "t_documents", "t_sections", "t_chunks", "t_vectors")


@query(
    "table_counts",
    with_ctes(
        """
        SELECT (SELECT count(*) FROM t_companies) AS company_tickers_exchange,
               (SELECT count(*) FROM t_tickers) AS company_tickers,
               (SELECT count(*) FROM t_documents) AS documents,
               (SELECT count(*) FROM t_sections) AS sections,
               (SELECT count(*) FROM t_chunks) AS chunks,
               (SELECT count(*) FROM t_vectors) AS embeddings
        """,
        *_ALL,
    ),
)
def counts(spark, sf_dir):
    return table_counts(spark, _tables(spark, sf_dir))


@query(
    "search_capabilities",
    with_ctes(
        """
        SELECT c > 0 AS fts_available, e > 0 AS vector_available, c > 0 OR e > 0 AS hybrid_available,
               CASE WHEN c > 0 THEN 'BM25' ELSE 'LIKE' END AS search_method,
               c AS total_chunks, e AS total_embeddings, d AS vector_dimensions,
               CAST(0.3 AS DOUBLE) AS default_fts_weight, CAST(0.7 AS DOUBLE) AS default_semantic_weight
        FROM (SELECT (SELECT count(*) FROM t_chunks) AS c, (SELECT count(*) FROM t_vectors) AS e,
                     (SELECT mode(len(embedding)) FROM t_vectors) AS d)
        """,
        "t_chunks",
        "t_vectors",
    ),
)
def search_capabilities(spark, sf_dir):
    return capabilities(spark, _tables(spark, sf_dir))


@query(
    "documents_per_company",
    with_ctes(
        """
        SELECT coalesce(n.company_name, d.cik) AS company, count(*) AS documents,
               count(DISTINCT d.year) AS years
        FROM t_documents d LEFT JOIN t_names n ON n.cik = d.cik GROUP BY 1
        """,
        "t_documents",
        "t_names",
    ),
)
def documents_per_company(spark, sf_dir):
    """Counted per cik and year first, so a dominant company shuffles a few rows only."""
    tables = _tables(spark, sf_dir)
    per_year = tables[DOCUMENTS].groupBy("cik", "year").agg(F.count(F.lit(1)).alias("n"))
    per_cik = per_year.groupBy("cik").agg(F.sum("n").alias("documents"), F.count("year").alias("years"))
    return per_cik.join(company_names(tables[COMPANIES]), "cik", "left").select(
        F.coalesce("company_name", "cik").alias("company"), "documents", "years"
    )


# -- requests -------------------------------------------------------------------------------------

_REQUEST_COLUMNS = """
    'd' || doc_id AS request_id, text AS query, n_chars % 121 AS lim,
    CASE WHEN doc_id % 7 = 0 THEN -1.0 ELSE 0.5 END AS min_score,
    (doc_id % 25) / 10.0 AS max_distance, (doc_id % 12) / 10.0 AS fts_weight
"""


def _document_requests(spark, sf_dir):
    """Every document as a request, with bounds it keeps or breaks depending on its number."""
    return raw(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("request_id"),
        F.col("text").alias("query"),
        (F.col("n_chars") % 121).cast("int").alias("limit"),
        F.when(F.col("doc_id") % 7 == 0, -1.0).otherwise(0.5).alias("min_score"),
        ((F.col("doc_id") % 25) / 10.0).alias("max_distance"),
        ((F.col("doc_id") % 12) / 10.0).alias("fts_weight"),
    )


_REASONS = """
    concat_ws('; ', CASE WHEN trim(query) = '' THEN 'blank query' END,
              CASE WHEN lim < 1 OR lim > 100 THEN 'limit out of bounds' END,
              CASE WHEN min_score < 0 THEN 'min_score out of bounds' END,
              CASE WHEN max_distance < 0 OR max_distance > 2 THEN 'max_distance out of bounds' END,
              CASE WHEN fts_weight < 0 OR fts_weight > 1 THEN 'fts_weight out of bounds' END)
"""


@query(
    "requests_accepted",
    f"""
    SELECT request_id, query, lim AS limit_rows,
           {rounded('fts_weight', 'fts_weight')}, CAST(0.7 AS DOUBLE) AS semantic_weight, TRUE AS normalize_scores
    FROM (SELECT {_REQUEST_COLUMNS} FROM documents) WHERE {_REASONS} = ''
    """,
)
def requests_accepted(spark, sf_dir):
    valid, _ = split_requests(with_defaults(_document_requests(spark, sf_dir)))
    return valid.select(
        "request_id",
        "query",
        F.col("limit").alias("limit_rows"),
        "fts_weight",
        "semantic_weight",
        "normalize_scores",
    )


@query(
    "requests_rejected",
    f"""
    SELECT request_id, reason
    FROM (SELECT request_id, {_REASONS} AS reason FROM (SELECT {_REQUEST_COLUMNS} FROM documents))
    WHERE reason <> ''
    """,
)
def requests_rejected(spark, sf_dir):
    _, rejected = split_requests(with_defaults(_document_requests(spark, sf_dir)))
    return rejected.select("request_id", "reason")


@query(
    "requests_one_knob",
    f"""
    SELECT request_id, {rounded('fts_weight', 'fts_weight')},
           {rounded('1.0 - fts_weight', 'semantic_weight')},
           greatest(1, least(50, lim)) AS limit_rows
    FROM (SELECT {_REQUEST_COLUMNS} FROM documents)
    """,
)
def requests_one_knob(spark, sf_dir):
    asked = _document_requests(spark, sf_dir).withColumn("semantic_weight", F.lit(None).cast("double"))
    return clamp_limit(complement_weights(asked)).select(
        "request_id", "fts_weight", "semantic_weight", F.col("limit").alias("limit_rows")
    )


# -- derivations ----------------------------------------------------------------------------------


@query(
    "document_totals",
    with_ctes(
        """
        SELECT doc_id, count(*) AS total_sections, CAST(sum(length(section_text)) AS BIGINT) AS total_chars
        FROM t_sections GROUP BY doc_id
        """,
        "t_sections",
    ),
)
def totals(spark, sf_dir):
    return document_totals(_tables(spark, sf_dir)[SECTIONS])


def _forward(spark, sf_dir):
    return forward_rows(
        _tables(spark, sf_dir)[CHUNKS].select(
            "chunk_id", "chunk_text", F.lit("").alias("cik"), F.lit(True).alias("linked")
        )
    )


@query("term_frequencies", with_ctes("SELECT term, chunk_id, tf FROM t_tf", "t_tf"))
def term_frequencies(spark, sf_dir):
    return posting_rows(_forward(spark, sf_dir)).select("term", "chunk_id", "tf")


@query(
    "postings",
    with_ctes(
        """
        SELECT t.term, t.chunk_id, t.tf, d.dl, l.cik
        FROM t_tf t JOIN t_dl d ON d.chunk_id = t.chunk_id JOIN t_labels l ON l.chunk_id = t.chunk_id
        """,
        "t_tf",
        "t_dl",
        "t_labels",
    ),
)
def postings(spark, sf_dir):
    """The stored postings, as searches read them."""
    return store(spark, sf_dir).postings().select("term", "chunk_id", "tf", "dl", "cik")


@query("term_statistics", with_ctes("SELECT term, df, cf FROM t_df", "t_df"))
def term_statistics(spark, sf_dir):
    return term_stats(_forward(spark, sf_dir))


@query(
    "chunk_token_counts",
    with_ctes(
        "SELECT c.chunk_id, coalesce(d.dl, 0) AS dl FROM t_chunks c LEFT JOIN t_dl d ON d.chunk_id = c.chunk_id",
        "t_chunks",
        "t_dl",
    ),
)
def chunk_token_counts(spark, sf_dir):
    return _forward(spark, sf_dir).select("chunk_id", "dl")


@query(
    "corpus_statistics",
    with_ctes(
        f"SELECT n_chunks, {rounded('avgdl', 'avgdl')}, n_postings FROM t_corpus", "t_corpus"
    ),
)
def corpus_statistics(spark, sf_dir):
    return corpus_stats(_forward(spark, sf_dir))


@query(
    "english_vocabulary",
)
def english_vocabulary(spark, sf_dir):
    """Stemmed terms without stopwords, with their frequencies."""
    from gleaner.plans.store import Analyzer

    return store(spark, sf_dir).terms(Analyzer.english())


@query(
    "chunks_containing",
    with_ctes(
        "SELECT chunk_id, char_count FROM t_chunks WHERE chunk_text ILIKE '%License%'", "t_chunks"
    ),
)
def chunks_containing(spark, sf_dir):
    chunks = _tables(spark, sf_dir)[CHUNKS]
    return chunks.where(contains_ci(F.col("chunk_text"), "License")).select("chunk_id", "char_count")
