"""Token counts with a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file and
its library's version. Known pairs come from the cache by a join; each distinct text that is missing
is encoded once and appended.

Normalising may only remove what the tokenizer drops itself: for a tokenizer that drops white space
(``drops_space``) runs of ASCII white space become one blank and ends are trimmed; otherwise the text
is taken as it is. Such a tokenizer also works word by word, so a worker encodes each word once and
adds up.

Defined results: null and empty texts have no tokens; repeated rows get the same count; an empty
table gives an empty result and leaves the cache as it is. Columns of ``docs`` that have the name of
a result column are replaced. Two runs that append the same digest at a time do no harm: the cache
is read by distinct digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.shared import SPACE, require, ship, shipped, small_batches

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
MEMO_WORDS = 400_000  # of a worker; a full memo is emptied


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file: ``.json`` for tokenizers, ``.model`` for sentencepiece."""

    content: bytes
    kind: str
    drops_space: bool

    @classmethod
    def read(cls, path: str | Path, drops_space: bool = False) -> TokenizerFile:
        kind = Path(path).suffix.lstrip(".")
        if kind not in ("json", "model"):
            raise ValueError(f"no library for {path}")
        return cls(Path(path).read_bytes(), kind, drops_space)

    @property
    def version(self) -> str:
        if self.kind == "json":
            import tokenizers as library
        else:
            import sentencepiece as library
        return hashlib.sha256(self.content).hexdigest()[:32] + f"-{self.kind}-{library.__version__}-{self.drops_space}"

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Counts of whole strings, without begin, end or added special tokens."""
        if self.kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.content.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def normalised(text: Column, drops_space: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, SPACE, " ")) if drops_space else text


class Encoder:
    """Counts of texts; a worker has one for all its tasks, with the words it has met."""

    def __init__(self, file: TokenizerFile):
        self.file = file
        self.count: Callable[[list[str]], list[int]] | None = None
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        self.count = self.count or self.file.counter()
        return self._by_words(texts) if self.file.drops_space else self.count(texts)

    def _by_words(self, texts: list[str]) -> list[int]:
        """Counts of texts as sums over their words."""
        split = [text.encode().split() for text in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list({word for words in split for word in words if word not in self.memo})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.memo.update(zip(part, self.count([word.decode() for word in part]), strict=True))
        return [sum(map(self.memo.__getitem__, words)) for words in split]


def encode_misses(misses: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """``(digest, n_tokens)`` of ``(digest, content)``."""
    shared = ship(misses.sparkSession, Encoder(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Encoder = shipped(shared)
        for batch in batches:
            counts = encoder(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return misses.mapInArrow(encode, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` that the cache holds for a tokenizer, once each."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; fills the cache first.

    ``cache`` is a folder that all executors share. Encoding happens when this is called, so that
    the returned frame only joins.
    """
    require(docs, "text")
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer.version
    content = normalised(F.col("text"), tokenizer.drops_space)
    digest = F.unhex(F.sha2(content, 256))
    missing = (
        docs.select(digest.alias("digest"), content.alias("content"))
        .join(read_cache(spark, cache, version), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.first("content").alias("content"))
    )
    counted = encode_misses(missing, tokenizer).withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").partitionBy("tokenizer").parquet(cache)

    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    known = read_cache(spark, cache, version).withColumnRenamed("digest", "_known")
    return (
        docs.select(*kept, digest.alias("_digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
        .join(known, F.col("_digest") == F.col("_known"), "left")
        .select(*kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
