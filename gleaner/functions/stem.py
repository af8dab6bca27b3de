"""English suffix stripping (M. F. Porter, "An algorithm for suffix stripping", 1980).

Spark has no stemmer, so this is the one place where text passes through Python: arrays of
tokens travel in Arrow batches and every task remembers the stems it has already worked out, so
a word costs a dictionary lookup. Applying it inside the row keeps the token stream out of any
shuffle or vocabulary join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Executors need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MEMO_ENTRIES = 1 << 20

# The suffix rules of steps 2, 3 and 4 of the published algorithm.
_STEP_2 = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("abli", "able"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
)
_STEP_3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)
_STEP_4 = (
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
)


def _shape(word: str) -> str:
    """One letter per position: ``v`` for vowels, ``c`` for consonants (``y`` depends on its left)."""
    shape = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and shape[i - 1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap_suffix(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """Apply the longest matching rule if what it leaves has a positive measure."""
    matching = [rule for rule in rules if word.endswith(rule[0])]
    if not matching:
        return word
    suffix, replacement = max(matching, key=lambda rule: len(rule[0]))
    stem = word[: len(word) - len(suffix)]
    return stem + replacement if _measure(stem) > 0 else word


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_or_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            break
    else:
        return word
    if not _has_vowel(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _drop_ending(word: str) -> str:
    matching = [suffix for suffix in _STEP_4 if word.endswith(suffix)]
    if not matching:
        return word
    suffix = max(matching, key=len)
    stem = word[: -len(suffix)]
    if _measure(stem) <= 1 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _past_or_gerund(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap_suffix(_swap_suffix(word, _STEP_2), _STEP_3)
    return _tidy(_drop_ending(word))


class _Memo(dict):
    """Stems seen by one task, emptied when it outgrows its bound."""

    def __missing__(self, word: str) -> str:
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        self[word] = stem = stem_word(word)
        return stem


def stemmed(lists: pa.ListArray, memo: dict[str, str]) -> pa.ListArray:
    """Lists of words with each replaced by its stem, looked up once for each distinct word."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([None if word is None else memo[word] for word in coded.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    nulls = pc.is_null(lists) if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=nulls)


@F.arrow_udf(ArrayType(StringType()))
def _stem_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = _Memo()
    for lists in batches:
        yield stemmed(lists, memo)


def stem_tokens(token_array: Column) -> Column:
    return _stem_arrays(token_array)
