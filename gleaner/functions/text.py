"""Text expressions: accent folding, tokens, in-row term counts, contains-matching."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# Code points whose canonical decomposition may start with a basic Latin letter.
_LATIN_BLOCKS = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))
_COMBINING_MARKS = (0x0300, 0x036F)


@cache
def _fold_table() -> tuple[str, str]:
    """``translate`` arguments, from Unicode decomposition; trailing characters are deleted."""
    source, target = [], []
    for first, last in _LATIN_BLOCKS:
        for code in range(first, last + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base.isascii():
                source.append(chr(code))
                target.append(base)
    marks = "".join(chr(c) for c in range(_COMBINING_MARKS[0], _COMBINING_MARKS[1] + 1))
    return "".join(source) + marks, "".join(target)


def fold_accents(text: Column) -> Column:
    source, target = _fold_table()
    return F.translate(text, source, target)


def tokens(text: Column) -> Column:
    """Lower-case, accent-folded runs of ``a-z``, in reading order."""
    return F.array_remove(F.split(fold_accents(F.lower(text)), "[^a-z]+"), "")


def run_starts(sorted_tokens: Column) -> Column:
    """Positions at which a new token begins in a sorted, non-empty token array."""
    return F.filter(
        F.sequence(F.lit(0), F.size(sorted_tokens) - 1),
        lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)),
    )


def run_counts(sorted_tokens: Column, starts: Column) -> Column:
    """``array<struct<term, tf>>`` from a sorted token array and its run starts.

    Pass columns of an earlier projection: they are read once per run.
    """
    return F.transform(
        starts,
        lambda start, n: F.struct(
            F.get(sorted_tokens, start).alias("term"),
            (F.coalesce(F.get(starts, n + 1), F.size(sorted_tokens)) - start).alias("tf"),
        ),
    )


def like_ci(text: Column, pattern: str) -> Column:
    """Case-insensitive LIKE in which ``%`` and ``_`` are wildcards and nothing escapes them.

    Spark's default escape character makes a trailing backslash an error, so a control
    character that the pattern does not contain takes that role.
    """
    escape = next(c for c in map(chr, range(1, 32)) if c not in pattern)
    return F.like(F.lower(text), F.lit(pattern.lower()), F.lit(escape))


def contains_ci(text: Column, needle: str) -> Column:
    return like_ci(text, f"%{needle}%")


def upper_list(csv: Column) -> Column:
    return F.transform(plain_list(csv), lambda x: F.upper(x))


def plain_list(csv: Column) -> Column:
    """Comma list to array: split, trim, drop empties."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def excerpt(text: Column, width: int = 300) -> Column:
    return F.concat(F.substring(text, 1, width), F.lit("..."))
