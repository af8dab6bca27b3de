from __future__ import annotations

import json

from gleaner.schemas import CHUNKS, DOCUMENTS, EXPECTED_TABLES, SECTIONS
from gleaner.sources.filing_json import filing_tables, read_filing_lines, read_filings
from gleaner.sources.sinks import write_tables
from gleaner.sources.tables import (
    catalog_tables,
    missing_tables,
    open_tables,
    register_views,
    table_inventory,
)
from gleaner.sources.ticker_json import read_exchange_table, read_ticker_map


def test_ticker_map(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(
        json.dumps(
            {
                "0": {"cik_str": 320193, "ticker": "AAA", "title": "Alpha"},
                "1": {"cik_str": 5, "ticker": "B", "title": None},
            },
            indent=1,
        )
    )
    assert sorted(map(tuple, read_ticker_map(spark, str(path)).collect())) == [
        (0, 320193, "AAA", "Alpha"),
        (1, 5, "B", None),
    ]


def test_exchange_table_follows_its_field_order(spark, tmp_path):
    path = tmp_path / "table.json"
    path.write_text(
        json.dumps({"fields": ["name", "cik", "exchange", "ticker"], "data": [["A", 7, None, "AA"], ["B", 8, "X", "BB"]]})
    )
    assert sorted(map(tuple, read_exchange_table(spark, str(path)).collect())) == [
        (7, "A", "AA", None),
        (8, "B", "BB", "X"),
    ]


def test_filings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    filing = {"section_10": "ten", "section_1A": "risk", "section_1": "business", "section_7": " ", "other": "x"}
    (tmp_path / "in" / "5_2019.json").write_text(json.dumps(filing, indent=2))
    (tmp_path / "in" / "77_2020.json").write_text(json.dumps({"section_8": "money", "section_Z": "odd"}))
    found = filing_tables(read_filings(spark, str(tmp_path / "in")))
    documents = {row["doc_id"]: row for row in found[DOCUMENTS].collect()}
    assert (documents["5_2019"]["cik"], documents["5_2019"]["year"]) == ("5", 2019)
    assert (documents["5_2019"]["total_sections"], documents["5_2019"]["total_chars"]) == (3, 15)
    sections = [tuple(r) for r in found[SECTIONS].where("doc_id = '5_2019'").orderBy("section_no").collect()]
    assert [(s[2], s[4]) for s in sections] == [(1, "business"), (2, "risk"), (3, "ten")]
    assert sections[0][0] == "5_2019_1" and sections[1][3] == "Risk Factors"
    names = {r["section_name"] for r in found[SECTIONS].where("doc_id = '77_2020'").collect()}
    assert names == {"Financial Statements", "Z"}


def test_filing_lines(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text("\n".join(json.dumps({"filename": f"{n}_2018.json", "section_1": "b"}) for n in range(3)))
    assert sorted(r["cik"] for r in read_filing_lines(spark, str(path)).collect()) == ["0", "1", "2"]


def test_tables_round_trip(spark, tables, tmp_path):
    kept = {name: tables[name] for name in (DOCUMENTS, CHUNKS)}
    write_tables(kept, str(tmp_path))
    opened = open_tables(spark, str(tmp_path))
    assert set(opened) == set(kept)
    for name in kept:
        assert sorted(opened[name].collect()) == sorted(kept[name].collect())


def test_missing_and_inventory(spark, tables):
    kept = {name: frame for name, frame in tables.items() if name != SECTIONS}
    for name in EXPECTED_TABLES:
        spark.catalog.dropTempView(name)
    register_views(kept)
    try:
        assert [r["table_name"] for r in missing_tables(spark).collect()] == [SECTIONS]
        assert set(catalog_tables(spark)) == set(kept)
    finally:
        for name in kept:
            spark.catalog.dropTempView(name)
    rows = {r["table_name"]: r for r in table_inventory(spark, kept).collect()}
    assert (rows[SECTIONS]["present"], rows[SECTIONS]["row_count"]) == (False, 0)
    assert (rows[CHUNKS]["present"], rows[CHUNKS]["row_count"]) == (True, 9)
