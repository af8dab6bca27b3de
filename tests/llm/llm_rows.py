"""Awkward rows that the tests of this folder share."""

from __future__ import annotations

LONG = " ".join(f"w{i % 4001}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))

# Nulls, empty and very long texts, ties, repeated rows, one-word edits of lines and near copies.
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, BASE + " more"),
    (4, BASE.replace("word7 ", "other ")),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (8, LONG),
    (9, LONG.replace("w77 ", "x77 ")),
    (10, "short text"),
    (11, "Short TEXT"),
    (12, "one two three four five six seven eight nine ten\nsecond line of this document has nine plain words\nx"),
    (13, "one two three four five six seven eight nine eleven\nsecond line of this document has nine plain words"),
    (14, "one two three four five six seven eight nine\nzero second line of this document has nine plain words\nx"),
    (15, "a b c d e a b c d e a b c d e"),
    (16, "SHOUTING ALL THE WAY THROUGH THIS TEXT WITHOUT ANY STOP AT ALL"),
    (17, "### a *** b $$$ c %%% d &&& e ||| f <<< g >>> h i j k l"),
    (18, "une ligne écrite en français où les mots portent des accents été ñandú"),
    (18, "une ligne écrite en français où les mots portent des accents été ñandú"),
    (None, BASE.replace("word9 ", "")),
    (None, "only a null id tells these words from others in this small table"),
]
