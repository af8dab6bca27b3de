"""Packing without padding: every document is cut into pieces of power-of-two length.

A document's ids, closed by an end id, are cut into pieces of the longest length first, and the rest by
the binary digits of its length. A piece is a sequence of its own, so no sequence crosses documents
and none needs padding; sequences of one length lie in one directory, from which batches of equal
shape are drawn.

Tokens are made where rows are read and nothing is shuffled. A tokenizer that works word by word
(``drops_space``) encodes each word once per worker. Pieces are written to the shared folder before
they are returned: sequence numbers come from the task and its row order, and files settle them.

Defined results: null and empty texts consist of the end id alone; repeated rows are packed each by
itself; a very long text gives many pieces of the longest length; an empty table gives no pieces.
Columns of ``docs`` that have the name of a result column are replaced, all others come along.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gleaner.llm.shared import require, scratch, ship, shipped
from gleaner.llm.tokens import TokenizerFile

LONGEST = 4096
MEMO_WORDS = 700_000  # of a worker's newer memo; a full one becomes the older, which is given up
WORDS_AT_ONCE = 1024
TEXTS_AT_ONCE = 128
OUT_BYTES = 1 << 24  # ids of one outgoing batch, beyond which a new one begins

RESULT = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")
_ADDED = StructType([StructField(name, BinaryType() if name == "ids" else LongType()) for name in RESULT])


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths that ``n`` ids are cut into: whole ones first, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length(), -1, -1) if rest >> k & 1]


class IdEncoder:
    """Ids of texts as little-endian 32-bit bytes; a worker has one for all its tasks.

    Words go from the older memo to the newer one when they are met again, so frequent words stay.
    ``signs`` are those that the tokenizer parts from the ASCII letters before them, whose case it
    ignores: a word of letters and one sign is put together from the two, and its letters need no
    normalising. That this holds is the caller's word, as ``drops_space`` is.
    """

    def __init__(self, file: TokenizerFile, signs: str = ""):
        self.file = file
        self.signs = signs
        self.simple = re.compile(f"([A-Za-z]+)([{re.escape(signs)}]?)".encode()) if signs else None
        self.tokenizer = self.bare = None
        self.encode: Callable[[list[str]], list[list[int]]] | None = None
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _open(self) -> Callable[[list[str]], list[list[int]]]:
        if self.file.kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
            from tokenizers import Tokenizer

            self.tokenizer = tokenizer = Tokenizer.from_str(self.file.content.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.bare = _bare(self.file.content) if self.simple else None
            return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.file.content)
        return lambda texts: pieces.encode(texts, num_threads=1)

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.encode = self.encode or self._open()
        if not self.file.drops_space or self.file.kind != "json":
            return [np.array(ids, "<u4").tobytes() for ids in self.encode(texts)]
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        split = [text.encode().split() for text in texts]
        # each word of these texts is looked up once in the large memos
        words = set().union(*split)
        local = {word: ids for word in words if (ids := self.memo.get(word)) is not None}
        words -= local.keys()
        again = {word: ids for word in words if (ids := self.older.get(word)) is not None}
        new = list(words - again.keys())
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            again.update(zip(part, self._ids_of_words(part), strict=True))
        self.memo.update(again)
        local.update(again)
        return [b"".join(map(local.__getitem__, text)) for text in split]

    def _ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; those of letters and a sign from what is known of the letters in lower case."""
        if self.simple is None:
            return _encoded(self.tokenizer, words)
        if len(self.stems) > MEMO_WORDS:
            self.stems.clear()
        parts = [(m[1].lower(), m[2]) if (m := self.simple.fullmatch(word)) else (b"", word) for word in words]
        for tokenizer, new in (
            (self.bare, {stem for stem, _ in parts if stem not in self.stems}),
            (self.tokenizer, {rest for _, rest in parts if rest not in self.stems}),
        ):
            self.stems.update(zip(new, _encoded(tokenizer, list(new)), strict=True))
        return [self.stems[stem] + self.stems[rest] for stem, rest in parts]


def _encoded(tokenizer, words: list[bytes]) -> list[bytes]:
    """Ids of words, encoded in one text: where a token begins tells which word it is of."""
    decoded = [word.decode() for word in words]
    found = tokenizer.encode("\n".join(decoded), add_special_tokens=False)
    begins = np.cumsum([0] + [len(word) + 1 for word in decoded])
    at = np.array([begin for begin, _ in found.offsets], np.int64)
    ends = np.searchsorted(at, begins).tolist()  # tokens before each word
    ids = np.array(found.ids, "<u4").tobytes()
    return [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]


def _bare(content: bytes):
    """The same model for words of ASCII letters in lower case, which nothing has to normalise or cut."""
    from tokenizers import Tokenizer

    parts = json.loads(content)
    parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
    return Tokenizer.from_str(json.dumps(parts))


class _Pieces:
    """Columns of outgoing pieces, with the row of the batch that each comes from."""

    def __init__(self):
        self.row: list[int] = []
        self.columns: dict[str, list] = {name: [] for name in RESULT}
        self.size = 0

    def add(self, row: int, **values) -> None:
        self.row.append(row)
        for name, value in values.items():
            self.columns[name].append(value)
        self.size += len(values["ids"])

    def batch(self, given: pa.RecordBatch, kept: list[str]) -> pa.RecordBatch:
        rows = pa.array(self.row, pa.int64())
        carried = [given.column(name).take(rows) for name in kept]
        made = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in self.columns.items()]
        return pa.RecordBatch.from_arrays(carried + made, kept + list(RESULT))


def cut(
    docs: DataFrame, tokenizer: TokenizerFile, end_id: int, longest: int = LONGEST, signs: str = ""
) -> DataFrame:
    """Pieces as rows, lazily: other columns of ``docs``, then those of ``RESULT``.

    ``ids`` holds the ids of a piece as little-endian 32-bit numbers, ``start`` those of its document
    before it. Sequence numbers join the task's number and a count within the task. ``signs`` saves work
    with tokenizers that are known to part them from words; see ``IdEncoder``.
    """
    require(docs, "text")
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    kept = [c for c in docs.columns if c not in RESULT and c != "text"]
    shared = ship(docs.sparkSession, IdEncoder(tokenizer, signs))
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: IdEncoder = shipped(shared)
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                texts = [text or "" for text in batch.column("text").to_pylist()]
                out = _Pieces()
                for row, found in enumerate(encoder(texts)):
                    ids = found + end
                    total, start = len(ids) // 4, 0
                    for length in piece_lengths(total, longest):
                        part = ids[4 * start : 4 * (start + length)]
                        out.add(
                            row,
                            start=start,
                            length=length,
                            doc_tokens=total,
                            sequence_id=number,
                            offset=0,
                            ids=part,
                        )
                        start += length
                        number += 1
                        if out.size > OUT_BYTES:
                            yield out.batch(batch, kept)
                            out = _Pieces()
                yield out.batch(batch, kept)

    schema = StructType([docs.schema[c] for c in kept] + _ADDED.fields)
    return docs.select(*kept, "text").mapInArrow(pack, schema)


def pack(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    end_id: int,
    longest: int = LONGEST,
    folder: str | None = None,
    signs: str = "",
) -> DataFrame:
    """The pieces of all documents, written to directories by ``length`` and read back.

    ``folder`` is one that all executors share; without it a new one below the session's shared folder
    is taken. At most ``log2(longest) + 1`` directories are made.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "packed")
    pieces = cut(docs, tokenizer, end_id, longest, signs)
    # one open writer per length instead of a sort of all ids by length
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(longest.bit_length() + 1))
    try:
        pieces.write.option("compression", "zstd").partitionBy("length").parquet(folder)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(pieces.schema).parquet(folder).select(*pieces.columns)
