"""Small tables that several test modules share."""

from __future__ import annotations

SF_DIR = "/root/testdata/sf0.001"

COMPANY_ROWS = [
    (1, "Alpha_One", "AAA", "Nasdaq"),
    (1, "Alpha One Ltd", "AAB", "NYSE"),
    (2, "Beta%Corp", "BBB", None),
    (3, None, "CCC", "nasdaq"),
    (0, "Zero\\", "ZZZ", "NYSE"),
]
# doc, cik, year
DOCUMENT_ROWS = [("d1", "1", 2019), ("d2", "2", 2019), ("d3", "3", 2018), ("d4", "9", 2019)]
# section, doc
SECTION_ROWS = [("s1", "d1"), ("s2", "d2"), ("s3", "d3"), ("s4", "d4")]
# chunk, section, doc, text
CHUNK_ROWS = [
    ("c1", "s1", "d1", "apple apple banana"),
    ("c2", "s1", "d1", "banana cherry"),
    ("c3", "s2", "d2", "Apple pie, apple PIE"),
    ("c4", "s3", "d3", "cherry cherry cherry apple"),
    ("c5", "s4", "d4", "crème brûlée 100%"),
    ("c6", "s4", "d4", "123"),
    ("c7", "s2", "d2", "banana cherry"),
    ("x1", "missing", "d1", "apple orphan"),
    ("x2", "s1", "missing", "apple orphan"),
]
VECTOR_ROWS = [
    ("c1", [1.0, 0.0]),
    ("c2", [1.0, 1.0]),
    ("c3", [0.0, 2.0]),
    ("c4", [0.0, 0.0]),
    ("c5", [3.0, 3.0]),
    ("c7", [-1.0, 0.0]),
    ("c6", [1.0, 2.0, 3.0]),
    ("x1", [1.0, 0.0]),
    ("gone", [1.0, 0.0]),
]
