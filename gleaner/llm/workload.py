"""Registered queries of this package, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm import html_text, language, language_model, sql, whitening
from gleaner.llm.decontaminate import contaminated
from gleaner.llm.mixing import mix
from gleaner.llm.near_lines import dedup_lines
from gleaner.llm.near_sets import ngram_jaccard
from gleaner.llm.packing import pack
from gleaner.llm.quality import cascade, text_measures
from gleaner.llm.shared import lower_ascii, scratch
from gleaner.llm.spelling import MIN_LENGTH, variants
from gleaner.llm.tokens import TokenizerFile, count_tokens
from gleaner.llm.url_lists import host_of, judge

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 1: URL filters. The given pages carry no dates, so days and lists are derived from their URLs.


def _digit(column, at: int):
    """A number from 0 to 255 that the text decides."""
    return F.conv(F.substring(F.md5(column), at, 2), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page as fetched on a day of 2024 that its URL and id decide."""
    key = F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))
    return pages.select(
        "page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _digit(key, 1)).alias("fetched_on")
    )


def list_log(pages: DataFrame) -> DataFrame:
    """Three lists over the hosts of the pages: dated additions, removals and further additions."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), "url").where(F.col("host").isNotNull())
    domains = hosts.select(F.substring_index("host", ".", -3).alias("pattern")).distinct()
    full = hosts.select(F.col("host").alias("pattern")).distinct()
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    paths = hosts.where(first != "").select(F.concat("host", F.lit("/"), first).alias("pattern")).distinct()
    listed = (
        domains.where(_digit("pattern", 1) < 90).select(F.lit("domains").alias("list"), "pattern")
        .unionByName(full.where(_digit("pattern", 3) < 60).select(F.lit("hosts").alias("list"), "pattern"))
        .unionByName(paths.where(_digit("pattern", 5) < 60).select(F.lit("paths").alias("list"), "pattern"))
    )
    turns = F.array(
        *[
            F.struct(
                F.lit(seq).alias("seq"),
                F.lit(action).alias("action"),
                (_digit("pattern", 7) * 0 + sum((_digit("pattern", 7 + 2 * i) for i in range(seq + 1)), F.lit(0))).alias("shift"),
            )
            for seq, action in enumerate(("add", "remove", "add"))
        ]
    )
    return listed.select("list", "pattern", F.inline(turns)).select(
        "list", "pattern", "seq", "action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("shift")).alias("day")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = judge(captures_of(pages), list_log(pages))
    return judged.select("page_id", "fetched_on", "host", "blocked", "n_lists", "lists", "since")


def held_out(parts: int, part: int) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(5, 1).alias("held_out"), "text")
    model = language_model.fit(docs.where(~F.col("held_out")))
    return language_model.score(docs, model)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    # a cache of its own for each call: the figures are those of a cold cache
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer, scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return text_measures(judged).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (F.col("kept") & ~base).alias("kept"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed")
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages.select("page_id", "url", "html"), html_text.fit(pages))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks", "n_main")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def misspelt(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the letter runs of all texts, one in 31 without one of its code points."""
    letters = rf"([A-Za-z\u00C0-\u00FF]{{{MIN_LENGTH},}})"  # a shorter run gives no word
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(letters), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.select("run", F.crc32(key.cast("binary")).alias("h"), F.length("run").alias("length"))
    at = F.pmod("h", "length").cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("length")))
    word = F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt(table(spark, sf_dir, "documents"))
    found = variants(words.where("n >= 2"), ratio=10)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, tokenizer, end_id=2, longest=4096, signs=".,;:!?")
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it goes beyond a long; the operator gives it as a decimal."""
    vectors = whitening.quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    vectors = vectors.select("vec_id", "x")
    model, distinct = whitening.fit(vectors)
    if model is None:
        columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], columns)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return whitening.whiten(vectors, model).select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"),
        F.lit(whitening.identity_error(distinct, model)).alias("identity_error"),
    )


QUERIES: dict[str, Query] = {
    build.__name__: build
    for build in (
        op1_url_filters,
        op2_lm_scoring,
        op3_token_counts,
        op4_language_id,
        op5_benchmark_decontamination,
        op6_quality_rules,
        op7_ngram_jaccard,
        op8_line_dedup,
        op9_html_extraction,
        op10_source_mixing,
        op11_spelling_variants,
        op12_packing,
        op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filters": sql.URL_FILTERS,
    "op5_benchmark_decontamination": sql.DECONTAMINATION,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op7_ngram_jaccard": sql.NGRAM_JACCARD,
    "op8_line_dedup": sql.LINE_DEDUP,
    "op10_source_mixing": sql.SOURCE_MIXING,
}
