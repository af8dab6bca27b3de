"""Search layouts, written once per source and read by every search.

Four written tables, each arranged so that a search touches a small part of it:

Chunks are dealt to blocks of about a hundred by a hash of their id. All layouts use the same blocks:
a block lies in one directory of passages and one bucket of postings, and its rows lie together, in
small pages, so naming a block reads little else.

``passages``  chunk text with its labels, clustered by ``part`` (a hash of the chunk id) and block. A search
              ends with at most 100 rows per request; joining them on ``(part, chunk_id)`` lets
              dynamic partition pruning read only the directories that hold those rows.
``forward``   per chunk: length and ``(term, tf)`` pairs, counted inside the row. Read by the
              build steps below, so text is tokenised once.
``terms``     document and collection frequency per term, over all chunks.
``postings``  ``(term, chunk_id, tf, dl, cik, block)``, bucketed by chunk and sorted by term and block. All postings
              of a chunk share a bucket, so scores are summed where the rows are read, without a
              shuffle; a term holding a third of all rows spreads evenly over all buckets; and the
              sort lets a scan skip the pages of terms the query does not name.

``peaks``     for frequent terms the largest saturated count that a block holds: what tells a search
              which blocks cannot reach its results.
``grams``     the blocks in which three code points follow each other, for substring search.

``documents``  metadata without text, which lookups read.

``vectors`` holds ``(chunk_id, cik, embedding, norm)`` cut by ``(cik, chunk_id)`` ranges, so
company filters skip row groups and a dominant company still spreads over many files.

``ivf_*``     for approximate search: each vector once, with a compact code, in directories by its
              nearest centroid and in pages of few rows, so a search reads the codes of the
              directories it probes and the whole vectors of the rows it re-ranks.

``hashes``    for approximate search: each vector once per hash table, in directories by a hash of
              ``(table, bucket)`` and cut by ``(table, bucket, chunk_id)`` ranges, so a search opens
              the directories of its own buckets and a crowded bucket spreads over many files.
"""

from __future__ import annotations

import hashlib
import math
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gleaner.functions.grams import grams_of_blocks
from gleaner.functions.stem import stem_tokens
from gleaner.functions.text import run_counts, run_starts, tokens
from gleaner.functions.vectors import norm
from gleaner.schemas import CHUNKS, COMPANIES, DOCUMENTS, EMBEDDINGS, SECTIONS
from gleaner.sources.tables import Tables

_PASSAGES_PER_FILE = 2_000_000
_CHUNKS_PER_TASK = 100_000  # of text, by the size of files that a task reads
_KEYS_PER_TASK = 5_000_000
_POSTINGS_PER_BUCKET = 2_000_000  # sorted by one task
_POSTINGS_PER_CHUNK = 100
_VECTORS_PER_FILE = 200_000
_VECTORS_PER_PAGE = 64
_CHUNKS_PER_BLOCK = 128
_PASSAGES_PER_PAGE = 64
_POSTINGS_PER_PAGE = 1024
_PEAKS_PER_FILE = 20_000_000
# Terms found in so many chunks of an average block have peaks: the table stays that much smaller than postings.
_POSTINGS_PER_PEAK = 16
_GRAM_BYTES_PER_TASK = "16m"  # of passages as they are written
_SMALLEST_SHARE = 1_000
_PACKED = {"compression": "zstd"}
_MOST_DIRECTORIES = 4096
_MOST_BUCKETS = 50_000

_POSTINGS_SCHEMA = StructType(
    [
        StructField("term", StringType()),
        StructField("chunk_id", StringType()),
        StructField("tf", IntegerType()),
        StructField("dl", IntegerType()),
        StructField("cik", StringType()),
        StructField("block", IntegerType()),
    ]
)


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms. ``english`` adds stopwords and stemming to the plain rule."""

    name: str = "plain"
    stopwords: tuple[str, ...] = ()
    stemming: bool = False

    @staticmethod
    def english() -> "Analyzer":
        """The stopword list Spark ML ships, cut into tokens the way text is, and stemming."""
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords("english")
        pieces = {piece for word in words for piece in word.lower().split("'")}
        return Analyzer("english", tuple(sorted(pieces - {""})), True)

    @staticmethod
    def without(words: tuple[str, ...]) -> "Analyzer":
        """The plain rule without some words."""
        return Analyzer("plain", tuple(sorted(set(words))))

    @property
    def layout(self) -> str:
        """Name of what is written for this analyzer: by what it does, not by what it is called."""
        if not self.stopwords and not self.stemming:
            return "plain"
        content = repr((self.stopwords, self.stemming)).encode()
        return f"{self.name}_{hashlib.sha256(content).hexdigest()[:12]}"

    def terms(self, text: Column) -> Column:
        found = tokens(text)
        if self.stopwords:
            found = F.filter(found, lambda token: ~token.isin(*self.stopwords))
        return stem_tokens(found) if self.stemming else found


def shares(rows: int, target: int, cores: int) -> int:
    """How many files or directories: by size, but at least one per core once that pays."""
    by_size = math.ceil(rows / target)
    by_cores = min(cores, math.ceil(rows / _SMALLEST_SHARE))
    return max(1, by_size, by_cores)


def paged(rows: int) -> dict[str, str]:
    """Writer options for pages of so many rows, which scans with named values read singly."""
    return {"parquet.page.row.count.limit": str(rows), "parquet.page.size.row.check.min": str(rows), **_PACKED}


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession, least: int):
    """At least this many shuffle partitions for the jobs inside; adaptive joins stay adaptive."""
    name = "spark.sql.shuffle.partitions"
    return setting(spark, name, str(max(int(spark.conf.get(name)), least)))


@dataclass
class Store:
    """Layouts under ``path`` for one set of logical tables, each written on first use.

    With ``reuse`` complete layouts found under ``path`` are opened instead of written again, so one
    job can build a store that later sessions search. The caller answers for the tables being the
    ones it was built from. A store that is not ``ranked`` has no postings: text is searched by substring.
    """

    spark: SparkSession
    tables: Tables
    path: str
    reuse: bool = False
    ranked: bool = True
    _built: dict[str, DataFrame] = field(default_factory=dict)
    _facts: dict[str, Row] = field(default_factory=dict)
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def __post_init__(self) -> None:
        # Scans look up so many named values in page statistics; beyond, only their range is used.
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "2000")

    @property
    def _cores(self) -> int:
        """Cores of the session that wrote the store: the layouts were cut for that number."""
        here = self.spark.sparkContext.defaultParallelism
        return self._fact("cores", lambda: self.spark.range(1).select(F.lit(here).alias("n")))["n"]

    def _complete(self, name: str) -> bool:
        context = self.spark.sparkContext
        marker = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return marker.getFileSystem(context._jsc.hadoopConfiguration()).exists(marker)

    def _has(self, name: str) -> bool:
        """Whether a layout is there, written by this session or to be opened."""
        with self._lock:
            return name in self._built or (self.reuse and self._complete(name))

    def _written(self, name: str, write: Callable[[str], None]) -> DataFrame:
        with self._lock:
            if name not in self._built:
                target = f"{self.path}/{name}"
                if not (self.reuse and self._complete(name)):
                    write(target)
                self._built[name] = self.spark.read.parquet(target)
            return self._built[name]

    def fact(self, name: str, compute: Callable[[], DataFrame]) -> Row:
        """What an operator has worked out once about this store; see ``_fact``."""
        return self._fact(name, compute)

    def _fact(self, name: str, compute: Callable[[], DataFrame]) -> Row:
        """A one-row frame, computed once; kept beside the layouts of a store to be reused."""
        with self._lock:
            if name not in self._facts:
                frame = (
                    self._written(
                        f"fact_{name}",
                        lambda target: compute().write.mode("overwrite").parquet(target),
                    )
                    if self.reuse
                    else compute()
                )
                self._facts[name] = frame.first()
            return self._facts[name]

    # -- documents ----------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        """Document metadata without text, for lookups: in the order lists are shown in, with a
        Bloom filter on ``doc_id``, so that one document is read from one row group."""

        def write(target: str) -> None:
            (
                self.tables[DOCUMENTS]
                .repartitionByRange("cik", F.desc("year"), "filename")
                .sortWithinPartitions("cik", F.desc("year"), "filename")
                .write.mode("overwrite")
                .option("parquet.bloom.filter.enabled#doc_id", "true")
                .parquet(target)
            )

        return self._written("documents", write)

    # -- passages -----------------------------------------------------------------------------

    def passages(self) -> DataFrame:
        """Every chunk with its labels; ``linked`` marks those whose section and document exist."""
        return self._written("passages", self._write_passages)

    def _chunk_count(self) -> int:
        def compute() -> DataFrame:
            return self.tables[CHUNKS].agg(F.count(F.lit(1)).alias("n"))

        return self._fact("chunks", compute)["n"]

    def chunk_count(self) -> int:
        return self._chunk_count()

    def part_count(self) -> int:
        return min(_MOST_DIRECTORIES, shares(self._chunk_count(), _PASSAGES_PER_FILE, self._cores))

    def part_of(self, chunk_id: Column) -> Column:
        return F.pmod(F.hash(chunk_id), F.lit(self.part_count()))

    def block_count(self) -> int:
        """A multiple of the directories of passages and of the buckets of postings.

        All three are remainders of the same hash, so a block lies in one of each.
        """
        step = math.lcm(self.part_count(), self._bucket_count())
        return step * math.ceil(max(1, self._chunk_count()) / _CHUNKS_PER_BLOCK / step)

    def block_of(self, chunk_id: Column) -> Column:
        return F.pmod(F.hash(chunk_id), F.lit(self.block_count()))

    def passage_tasks(self) -> int:
        """About how many tasks read all passages or term counts."""
        return shares(self._chunk_count(), _CHUNKS_PER_TASK, 1)

    def posting_tasks(self) -> int:
        return self._bucket_count()

    def vector_tasks(self) -> int:
        return shares(self.vector_count(), _VECTORS_PER_FILE, 1)

    def _bucket_count(self) -> int:
        """Buckets of postings: by the chunks, as blocks are made before terms are counted."""
        rows = self._chunk_count() * _POSTINGS_PER_CHUNK
        return min(_MOST_BUCKETS, shares(rows, _POSTINGS_PER_BUCKET, self._cores))

    def _write_passages(self, target: str) -> None:
        rows, parts = self._chunk_count(), self.part_count()
        # A multiple of the directory count: the shuffle hashes as ``part_of`` does, so every task
        # then holds rows of one directory, however many tasks share it. A task sorts its texts, so
        # there are as many as keep them in memory, and as many as a join would be given: with fewer
        # it would move the texts once more.
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        by_size = shares(rows, min(_PASSAGES_PER_FILE, _CHUNKS_PER_TASK), self._cores)
        tasks = parts * math.ceil(max(least, by_size) / parts)
        chunks = self.tables[CHUNKS]
        sections = self.tables[SECTIONS].select("section_id", "section_name")
        documents = self.tables[DOCUMENTS].select("doc_id", "cik", "filename")
        # Labels are resolved on key columns alone; the text then moves once, by chunk id.
        labels = (
            chunks.select("chunk_id", "section_id", "doc_id")
            .join(sections, "section_id")
            .join(documents, "doc_id")
            .select("chunk_id", "cik", "filename", "section_name", F.lit(True).alias("linked"))
        )
        with shuffle_partitions(self.spark, tasks):
            (
                chunks.repartition(tasks, "chunk_id")
                .join(labels, "chunk_id", "left")
                .withColumn("linked", F.coalesce("linked", F.lit(False)))
                .withColumn("part", self.part_of(F.col("chunk_id")))
                .withColumn("block", self.block_of(F.col("chunk_id")))
                .sortWithinPartitions("part", "block", "chunk_id")
                .write.mode("overwrite")
                .options(**paged(_PASSAGES_PER_PAGE))
                .partitionBy("part")
                .parquet(target)
            )

    # -- terms and postings -------------------------------------------------------------------

    def forward(self, analyzer: Analyzer = Analyzer()) -> DataFrame:
        def write(target: str) -> None:
            (
                forward_rows(self.passages(), analyzer)
                .write.mode("overwrite")
                .options(**_PACKED)
                .parquet(target)
            )

        return self._written(f"forward_{analyzer.layout}", write)

    def corpus(self, analyzer: Analyzer = Analyzer()) -> Row:
        """``n_chunks``, ``avgdl`` over chunks with tokens, ``n_postings``: one row."""
        return self._fact(f"corpus_{analyzer.layout}", lambda: corpus_stats(self.forward(analyzer)))

    def terms(self, analyzer: Analyzer = Analyzer()) -> DataFrame:
        def write(target: str) -> None:
            rows = self.corpus(analyzer)["n_postings"]
            # Counts combine before the shuffle; the bound is for a vocabulary of unlike terms.
            with shuffle_partitions(self.spark, shares(rows, 100 * _KEYS_PER_TASK, 1)):
                (
                    term_stats(self.forward(analyzer))
                    .sortWithinPartitions("term")
                    .write.mode("overwrite")
                    .parquet(target)
                )

        return self._written(f"terms_{analyzer.layout}", write)

    def postings(self, analyzer: Analyzer = Analyzer()) -> DataFrame:
        """Postings of linked chunks; the frequencies in ``terms`` still count all chunks."""
        name = f"postings_{analyzer.layout}"
        with self._lock:
            if name not in self._built:
                buckets = self._bucket_count()
                table = f"gleaner_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{name}"
                if self.reuse and self._complete(name):
                    self._attach_postings(table, f"{self.path}/{name}", buckets)
                else:
                    self._write_postings(table, f"{self.path}/{name}", buckets, analyzer)
                self._built[name] = self.spark.table(table)
            return self._built[name]

    def _write_postings(self, table: str, target: str, buckets: int, analyzer: Analyzer) -> None:
        # One text and one array a chunk are shuffled, not the rows they unfold into.
        placed = folded_terms(self.forward(analyzer).where("linked")).repartition(buckets, "chunk_id")
        # A task holds one bucket, in term order already. With a writer per open bucket Spark keeps
        # that order; by default it would sort again, by bucket number first.
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "1"):
            (
                posting_rows(unfolded_terms(placed))
                .withColumn("block", self.block_of(F.col("chunk_id")))
                .sortWithinPartitions("term", "block", "chunk_id")
                .write.mode("overwrite")
                .options(**paged(_POSTINGS_PER_PAGE))
                .bucketBy(buckets, "chunk_id")
                .option("path", target)
                .saveAsTable(table)
            )

    def _attach_postings(self, table: str, target: str, buckets: int) -> None:
        """Name files an earlier session wrote, with the bucketing they were written in."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _POSTINGS_SCHEMA)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY (chunk_id) INTO {buckets} BUCKETS "
            f"LOCATION '{target}'"
        )

    def peak_terms_from(self) -> int:
        """Chunks that a term must be in to have peaks."""
        return self.block_count() * _POSTINGS_PER_PEAK

    def has_peaks(self, name: str, analyzer: Analyzer = Analyzer()) -> bool:
        return self._has(_peaks_layout(name, analyzer))

    def peaks(self, name: str, saturation: Callable[[float], Column], analyzer: Analyzer = Analyzer()) -> DataFrame:
        """``(term, block, peak)`` of frequent terms: the largest ``saturation`` that a block's postings have.

        ``saturation`` is an expression over ``tf`` and ``dl``, given the average length; ``name`` stands for it.
        """

        def write(target: str) -> None:
            frequent = self.terms(analyzer).where(F.col("df") >= self.peak_terms_from()).select("term")
            value = saturation(self.corpus(analyzer)["avgdl"] or 1.0)
            rows = self.corpus(analyzer)["n_postings"] // _POSTINGS_PER_PEAK
            (
                self.postings(analyzer)
                .join(frequent, "term")
                .groupBy("term", "block")
                .agg(F.max(value).alias("peak"))
                .repartitionByRange(shares(rows, _PEAKS_PER_FILE, self._cores), "term", "block")
                .sortWithinPartitions("term", "block")
                .write.mode("overwrite")
                .options(**paged(_POSTINGS_PER_PAGE))
                .parquet(target)
            )

        return self._written(_peaks_layout(name, analyzer), write)

    # -- substrings ---------------------------------------------------------------------------

    def write_grams(self) -> None:
        """The index of substrings, for a corpus that will be searched often."""
        self.grams()
        self.gram_counts()

    def has_grams(self) -> bool:
        return self._has("grams") and self._has("gram_counts")

    def grams(self) -> DataFrame:
        """``(gram, block, slots)``: where linked passages hold three code points in a row.

        A block's chunks are dealt to 64 slots, one bit each, so grams that a block has in different
        chunks are told apart. A block can have two rows for a gram, where its passages were read apart.
        Grams are sorted where they are made, so nothing moves: a scan reads a few pages of every file.
        """

        def write(target: str) -> None:
            # Tasks read so little that what they sort stays in memory.
            with setting(self.spark, "spark.sql.files.maxPartitionBytes", _GRAM_BYTES_PER_TASK):
                (
                    block_grams(self.passages().where("linked"))
                    .sortWithinPartitions("gram", "block")
                    .write.mode("overwrite")
                    .options(**paged(_POSTINGS_PER_PAGE))
                    .parquet(target)
                )

        return self._written("grams", write)

    def gram_counts(self) -> DataFrame:
        """``(gram, n)``: in how many slots a gram is found."""

        def write(target: str) -> None:
            counted = self.grams().groupBy("gram").agg(F.sum(F.bit_count("slots").cast("long")).alias("n"))
            counted.sortWithinPartitions("gram").write.mode("overwrite").parquet(target)

        return self._written("gram_counts", write)

    # -- vectors ------------------------------------------------------------------------------

    def _vector_facts(self) -> Row:
        """Vector length (that of the most vectors, the smaller one on a draw) and row count."""

        return self._fact("vectors", lambda: vector_facts(self.tables[EMBEDDINGS]))

    def dimensions(self) -> int | None:
        return self._vector_facts()["dimensions"]

    def vectors(self) -> DataFrame:
        def write(target: str) -> None:
            keys = self.passages().where("linked").select("chunk_id", "cik")
            usable, _ = split_vectors(self.tables[EMBEDDINGS], self.dimensions())
            files = shares(self._vector_facts()["n"] or 0, _VECTORS_PER_FILE, self._cores)
            with shuffle_partitions(self.spark, shares(self._chunk_count(), _KEYS_PER_TASK, 1)):
                (
                    usable.join(keys, "chunk_id")
                    .select("chunk_id", "cik", "embedding", "norm")
                    .repartitionByRange(files, "cik", "chunk_id")
                    .sortWithinPartitions("cik", "chunk_id")
                    .write.mode("overwrite")
                    .options(**_PACKED)
                    .parquet(target)
                )

        return self._written("vectors", write)

    def vector_count(self) -> int:
        return self._vector_facts()["n"] or 0

    def inverted_lists(self, name: str, placed: Callable[[], DataFrame]) -> DataFrame:
        """Vectors by ``list``; ``placed`` gives the stored ones with that column and their codes."""

        def write(target: str) -> None:
            files = shares(self.vector_count(), _VECTORS_PER_FILE, self._cores)
            (
                placed()
                .repartitionByRange(files, "list", "chunk_id")
                .sortWithinPartitions("list", "chunk_id")
                .write.mode("overwrite")
                .options(**paged(_VECTORS_PER_PAGE))
                .partitionBy("list")
                .parquet(target)
            )

        return self._written(name, write)

    def hashes(self, name: str, buckets: Callable[[DataFrame], DataFrame], tables: int) -> DataFrame:
        """Vectors by hash bucket; ``buckets`` adds an array column with one bucket per table."""

        def write(target: str) -> None:
            rows = tables * (self._vector_facts()["n"] or 0)
            files = shares(rows, _VECTORS_PER_FILE, self._cores)
            (
                buckets(self.vectors().where("norm > 0"))
                .select("*", F.posexplode("buckets").alias("table", "bucket"))
                .withColumn("slot", self.slot_of(tables))
                .repartitionByRange(files, "slot", "table", "bucket", "chunk_id")
                .sortWithinPartitions("slot", "table", "bucket", "chunk_id")
                .write.mode("overwrite")
                .partitionBy("slot")
                .parquet(target)
            )

        return self._written(f"hashes_{name}", write)

    def slot_of(self, tables: int) -> Column:
        rows = tables * (self._vector_facts()["n"] or 0)
        slots = min(_MOST_DIRECTORIES, shares(rows, _VECTORS_PER_FILE, self._cores))
        return F.pmod(F.hash("table", "bucket"), F.lit(slots))

    @property
    def has_vectors(self) -> bool:
        return EMBEDDINGS in self.tables and (self.dimensions() or 0) > 0

    @property
    def companies(self) -> DataFrame:
        return self.tables[COMPANIES]

    def company_names(self) -> DataFrame:
        """One name per cik, which every labelled result is joined with."""

        def write(target: str) -> None:
            company_names(self.companies).sortWithinPartitions("cik").write.mode("overwrite").parquet(target)

        return self._written("company_names", write)


def _peaks_layout(name: str, analyzer: Analyzer) -> str:
    return f"peaks_{analyzer.layout}_{name}"


def company_names(companies: DataFrame) -> DataFrame:
    """One name per cik, as text."""
    return companies.groupBy(F.col("cik").cast("string").alias("cik")).agg(
        F.min("name").alias("company_name")
    )


def forward_rows(passages: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """Per chunk: token count and term frequencies, both counted inside the row."""
    found = analyzer.terms(F.coalesce("chunk_text", F.lit("")))
    keys = ("chunk_id", "cik", "linked")
    starts = F.when(F.size("found") > 0, run_starts(F.col("found")))
    terms = run_counts(F.col("found"), F.col("starts"))
    return (
        passages.select(*keys, F.sort_array(found).alias("found"))
        .select(*keys, "found", F.coalesce(starts, F.array().cast("array<int>")).alias("starts"))
        .select(*keys, F.size("found").alias("dl"), terms.alias("terms"))
    )


def _exploded_terms(forward: DataFrame, *columns: str) -> DataFrame:
    """One row per (chunk, term).

    The outer form with a check behind it: for a plain ``explode`` the optimizer infers a filter on
    the array's size and pushes it below the projections that build the array, which would be
    worked out twice, and per element.
    """
    return forward.select(*columns, F.explode_outer("terms").alias("t")).where("t IS NOT NULL")


def folded_terms(forward: DataFrame) -> DataFrame:
    """Chunks that have terms, with these as one text: letters alone, so a space parts them.

    An array of pairs takes several times the room on its way.
    """
    return forward.where(F.size("terms") > 0).select(
        "chunk_id", "cik", "dl", F.array_join("terms.term", " ").alias("names"), F.col("terms.tf").alias("tfs")
    )


def unfolded_terms(folded: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.split("names", " ").alias("term"), F.col("tfs").alias("tf"))
    return folded.select("chunk_id", "cik", "dl", pairs.alias("terms"))


def posting_rows(forward: DataFrame) -> DataFrame:
    return _exploded_terms(forward, "chunk_id", "cik", "dl").select(
        "t.term", "chunk_id", "t.tf", "dl", "cik"
    )


def block_grams(passages: DataFrame) -> DataFrame:
    """``(gram, block, slots)`` of lower-cased text, as rows lie: each task's blocks without repeats."""
    slot = F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int").alias("slot")
    lowered = passages.select("block", slot, F.lower("chunk_text").alias("text")).where("text IS NOT NULL")
    return lowered.mapInArrow(grams_of_blocks, "gram long, block int, slots long")


def corpus_stats(forward: DataFrame) -> DataFrame:
    """Chunk count, average length of chunks that have tokens, number of (term, chunk) pairs."""
    return forward.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"),
        F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0)).alias("n_postings"),
    )


def term_stats(forward: DataFrame) -> DataFrame:
    """Chunks per term and occurrences per term."""
    return (
        _exploded_terms(forward)
        .groupBy("t.term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("t.tf").cast("long")).alias("cf"))
    )


def vector_facts(embeddings: DataFrame) -> DataFrame:
    """The length that vectors are taken to have (that of the most, the smaller on a draw), and their number."""
    sizes = embeddings.groupBy(F.size("embedding").alias("d")).count()
    best = F.max_by("d", F.struct("count", -F.col("d")))
    return sizes.agg(best.alias("dimensions"), F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("n"))


def split_vectors(embeddings: DataFrame, dimensions: int | None) -> tuple[DataFrame, DataFrame]:
    """Vectors of the right length, with their norm, and the ones to reject."""
    fits = F.coalesce(F.size("embedding") == F.lit(dimensions), F.lit(False))
    usable = embeddings.where(fits).withColumn("norm", norm(F.col("embedding")))
    return usable, embeddings.where(~fits)
