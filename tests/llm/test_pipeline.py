"""The pipeline's stages on a small table, each against plain code on what the stage before kept."""

from __future__ import annotations

from pathlib import Path

import pytest

import brute
import corpus_pipeline
from llm_rows import ROWS

FILLER = "plain words of a document that says nothing twice and goes on for a little while longer number"


def _documents():
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in ROWS]
    rows += [(100 + i, f"{FILLER} {' '.join(f'n{i}k{k}' for k in range(30))}", "en", "s1", 200) for i in range(12)]
    rows += [(200, " ".join(f"bench{i}" for i in range(14)) + " and so on", "en", "s2", 100)]
    rows += [(201 + i, " ".join(f"c{k}" for k in range(40)) + f" tail{i} end{i}", "de", None, 150) for i in range(3)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(_documents(), schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    items = [(1, " ".join(f"bench{i}" for i in range(14))), (2, "not there at all, whatever one may look for in it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality rules",
        "line dedup",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "source mixing",
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)

    kept = corpus_pipeline.written(stage["quality rules"](spark, docs, sf_dir), "test")
    assert kept.columns == columns
    ids = {r[0] for r in rows_of(kept)}
    assert ids & {5, 6, 7, 8, 10, 11, 15, 16, 17} == set() and {1, 18, 100, 200} <= ids

    before = rows_of(kept)
    lined = corpus_pipeline.written(stage["line dedup"](spark, kept, sf_dir), "test")
    assert lined.columns == columns
    distinct = list(dict.fromkeys(before))
    gone = dict(zip(distinct, brute.removed_lines(distinct, 8), strict=True))
    expected = []
    for row in before:
        lines = [line for k, line in enumerate(row[1].split("\n")) if k not in gone[row]]
        if not gone[row] or brute.words("\n".join(lines)):
            expected.append((row[0], "\n".join(lines)))
    assert rows_of(lined) == sorted(expected, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect() if r["doc_id"] in (12, 13, 14))

    before = rows_of(lined)
    single = corpus_pipeline.written(stage["n-gram Jaccard join"](spark, lined, sf_dir), "test")
    assert single.columns == columns
    _, groups = brute.components(before, 5, 80)
    assert rows_of(single) == [r for i, r in enumerate(before) if i == min(groups[i])]

    before = rows_of(single)
    clean = corpus_pipeline.written(stage["benchmark decontamination"](spark, single, sf_dir), "test")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert rows_of(clean) == [r for r in before if not brute.hits(r[1], items)[1]]
    assert 200 not in {r[0] for r in rows_of(clean)}

    mixed = stage["source mixing"](spark, clean, sf_dir)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))


def test_a_copy_leaves_one_document(spark):
    """Copies go with their short lines; what repeats itself, or brings text of its own, stays."""
    body = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(6)]
    texts = ["\n".join(["A heading", *body, "the end"])] * 3  # 1 to 3: exact copies
    texts += ["\n".join(["Other heading", *body])]  # 4: a copy under another heading
    texts += ["\n".join(["A heading", *body[:4], *(b.replace("w7 ", "v7 ") for b in body[4:])])]  # 5: lines edited
    texts += ["\n".join([*body[:3], *(" ".join(f"own{k}w{i}" for i in range(20)) for k in range(3))])]  # 6: half is new
    texts += ["\n".join(["A heading", *(["one line of nine words that comes again here"] * 20)])]  # 7: repeats itself
    texts += ["\n".join([body[0], *(f"short line {i} alone" for i in range(20))])]  # 8: one line is not its own
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string, n_chars long")
    found = corpus_pipeline.line_dedup(spark, frame, "")
    assert found.columns == frame.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 6, 7, 8]


def test_stages_on_nothing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.count() == 0


def test_only_the_entry_guards_the_import():
    root = Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *sorted((root / "gleaner" / "llm").glob("*.py"))]:
        assert "ImportError" not in path.read_text() and "ModuleNotFoundError" not in path.read_text()
