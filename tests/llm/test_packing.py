"""Packing: an exact round trip to the library's ids."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from gleaner.llm.packing import pack, piece_lengths
from gleaner.llm.tokens import TokenizerFile


def test_piece_lengths():
    for n in range(1, 300):
        found = piece_lengths(n, 64)
        assert sum(found) == n and found == sorted(found, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 64 for x in found)
        assert len([x for x in found if x < 64]) == len({x for x in found if x < 64})


# Words that a sign, a case or a composed letter could make differ from what their parts give.
ODD = [
    "The. the, THE; a: B! c? d.. e., f!? .g ,, it's. we'll, x1. \u00e9. \u00c9a. K. \u017f. \u0130. i\u0307. I. 3. a.b c-d. \u00df!",
    "<|endoftext|>abc <|startoftext|> x<|endoftext|>. y",
    "\u00a0 nb\u00a0sp x\x1cy\x85z \u0301 \u0301a b\u0301. \U0001f600. \ud55c\uad6d\uc5b4. \x00a.\x00 a\r\nb.\tc,\x0bd",
]


@pytest.mark.parametrize(("drops_space", "signs"), [(True, ""), (True, ".,;:!?"), (False, "")])
def test_round_trip(spark, docs, drops_space, signs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    more = spark.createDataFrame([(1000 + i, text) for i, text in enumerate(ODD)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    odd = docs.selectExpr("doc_id", "text", "lang", "7 AS start", "'x' AS ids", "1 AS bucket", "'y' AS _number")
    found = pack(
        odd, TokenizerFile.read(path, drops_space), end_id=2, longest=1024, folder=str(tmp_path / "packed"), signs=signs)
    pieces = found.collect()
    library = Tokenizer.from_file(str(path))
    expected = sorted(
        (str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()
    )
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)
    assert {r["_number"] for r in pieces} == {"y"} and {r["bucket"] for r in pieces} == {1}
    parts = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        parts[str(r["doc_id"]), r["doc_tokens"], r["start"]].append(ids)
    # repeated rows give equal pieces as often as they occur
    whole = []
    for (doc, total, start), copies in sorted(parts.items()):
        if start == 0:
            for n in range(len(copies)):
                ids, at = [], 0
                while at < total:
                    options = parts[doc, total, at]
                    ids += options[n]
                    at += len(options[n])
                whole.append((doc, ids))
    assert sorted(whole) == expected
    assert {p.name.split("=")[0] for p in (tmp_path / "packed").iterdir() if p.is_dir()} == {"length"}


def test_empty_table_and_bad_length(spark, empty):
    tokenizer = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"), True)
    assert pack(empty, tokenizer, 2).collect() == []
    with pytest.raises(ValueError):
        pack(empty, tokenizer, 2, longest=1000)
