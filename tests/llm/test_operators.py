"""Operators against their plain versions on a small table of awkward rows, and on empty tables."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from llm_rows import ROWS
from gleaner.llm import html_text, language, language_model
from gleaner.llm.decontaminate import contaminated
from gleaner.llm.mixing import mix, route, targets
from gleaner.llm.near_lines import dedup_lines
from gleaner.llm.near_sets import ngram_jaccard, one_of_each
from gleaner.llm.quality import RULES, cascade, measure, text_measures
from gleaner.llm.shared import scratch, written
from gleaner.llm.tokens import TokenizerFile, count_tokens
from gleaner.llm.url_lists import host_of, intervals, judge


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, row["text"] or "")


def by_row(frame):
    return sorted(frame.collect(), key=key)


PLAIN = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_quality_measures(docs):
    found = by_row(text_measures(docs))
    for row, (_, text) in zip(found, PLAIN, strict=True):
        words = brute.SPACE_WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [line for line in (text or "").split("\n") if brute.SPACE_WORD.search(line)]
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(covered)


def test_quality_verdicts_do_not_depend_on_the_order(docs):
    one, other = cascade(docs), cascade(docs, RULES[::-1], sample_rows=3)
    assert [r["kept"] for r in by_row(one)] == [r["kept"] for r in by_row(other)]
    verdict = {r["doc_id"]: r for r in one.collect()}
    assert verdict[1]["kept"] and verdict[1]["rejected_by"] is None and verdict[18]["kept"]
    assert [verdict[i]["kept"] for i in (5, 6, 7, 10, 15, 16, 17)] == [False] * 7
    assert "removed" in one.columns and one.columns.count("kept") == 1


def test_quality_order_is_by_rejection_per_cost(docs):
    worth = [m.worth for m in measure(docs, RULES)]
    assert worth == sorted(worth, reverse=True) and len(worth) == len(RULES)


ITEMS = [
    (1, " ".join(f"word{i}" for i in range(5, 25))),
    (2, "never to be found in any of these documents at all, is it"),
    (3, "short TEXT"),
    (4, "ñandú"),
    (5, None),
    (6, "..."),
    (None, "seven eight nine ten"),
    (1, "a b c d e a b c d e a"),
]


@pytest.mark.parametrize("k", [1, 3, 5, 10])
def test_decontamination(spark, docs, k):
    found = by_row(contaminated(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), k=k))
    for row, (_, text) in zip(found, PLAIN, strict=True):
        assert (row["n_words"], row["n_hit"], row["item_ids"]) == brute.hits(text, ITEMS)
        assert row["contaminated"] == (row["n_hit"] > 0)


def test_decontamination_by_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr("gleaner.llm.decontaminate.BROADCAST_FINGERPRINTS", -1)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = by_row(contaminated(docs, items))
    assert [r["n_hit"] for r in got] == [brute.hits(t, ITEMS)[1] for _, t in PLAIN]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 30)])
def test_ngram_jaccard(docs, n, percent):
    sets, groups = brute.components(PLAIN, n, percent)
    for i, row in enumerate(by_row(ngram_jaccard(docs, n, percent))):
        ids = [PLAIN[j][0] for j in groups[i] if PLAIN[j][0] is not None]
        assert row["n_shingles"] == len(sets[i])
        assert row["component_id"] == (min(ids) if ids else None)


def test_ngram_jaccard_in_blocks(spark, monkeypatch):
    """Many near copies, in groups far above the block size, with links that only chains give."""
    monkeypatch.setattr("gleaner.llm.near_sets.BLOCK", 8)
    base = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(base[: 40 - i % 7] + [f"u{i}"] * (i % 3))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    _, groups = brute.components(rows, 2, 85)
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(frame, 2, 85).collect()}
    assert found == {i: min(g) for i, g in enumerate(groups)}


@pytest.mark.parametrize("block", [4096, 16])
def test_ngram_jaccard_writes_no_pairs_of_sets_that_do_not_link(spark, monkeypatch, block):
    """A template with three slots: any two of its texts lie just below the threshold."""
    monkeypatch.setattr("gleaner.llm.near_sets.BLOCK", block)
    made = []

    def counted(frame, label):
        made.append((label, (out := written(frame, label)).count()))
        return out

    monkeypatch.setattr("gleaner.llm.near_sets.written", counted)
    rows = []
    for i in range(60):
        text = [f"t{k}" for k in range(150)]
        text[20] = text[60] = text[100] = f"u{i}"
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1] + " more"), (101, "first " + rows[3][1]), (102, rows[9][1] + " last")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(frame).collect()}
    assert found == {i: {100: 3, 101: 3, 102: 9}.get(i, i) for i, _ in rows}
    if block > len(rows):
        assert max(n for label, n in made if label != "runs") <= 2 * len(rows)
    assert dict(made)["links"] < len(rows)


def test_one_of_each(docs):
    kept = one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    _, groups = brute.components(PLAIN, 4, 85)
    expected = []
    for i, (doc_id, text) in enumerate(PLAIN):
        if not brute.words(text) or i == min(groups[i]):
            expected.append((doc_id, text))
    assert [(r["doc_id"], r["text"]) for r in by_row(kept)] == expected


def test_line_dedup(docs):
    found = by_row(dedup_lines(docs))
    rows = list(dict.fromkeys(PLAIN))  # rows that agree in all share one fate
    gone = dict(zip(rows, brute.removed_lines(rows, 8), strict=True))
    for row, (doc_id, text) in zip(sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_words"])), PLAIN, strict=False):
        if doc_id is None:
            continue
        removed = gone[doc_id, text]
        assert row["removed"] == removed
        assert row["n_exact"] + row["n_near"] == len(removed)
        assert row["n_lines"] == (len(text.split("\n")) if text else 0)
        left = [line for k, line in enumerate((text or "").split("\n")) if k not in removed]
        assert (row["text"] or "") == "\n".join(left)


def test_line_dedup_with_a_growing_bound(spark):
    """One edit for ten words, at any place and of any kind, against plain edit distance."""
    draw = random.Random(5)
    lines = []
    for size in (12, 19, 20, 29, 35, 60, 90):
        base = [f"b{size}w{draw.randrange(size)}" for _ in range(size)]
        lines.append(base)
        for edits in range(1, size // 10 + 3):
            line = list(base)
            for k in range(edits):
                at = draw.randrange(len(line))
                line[at : at + draw.randrange(2)] = [f"e{size}k{edits}x{k}"] * draw.randrange(2)
            lines.append(line)
        lines.append([w if i % (size // max(1, size // 10) ) else f"s{size}w{i}" for i, w in enumerate(base)])
    rows = [(i, " ".join(ws)) for i, ws in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["removed"] for r in dedup_lines(frame, words_per_edit=10).collect()}
    near = lambda a, b: brute.edit_distance(a, b) <= max(1, min(len(a), len(b)) // 10)
    expected = {i: [0] if any(near(a, b) for b in lines[:i]) else [] for i, a in enumerate(lines)}
    assert found == expected
    once = {r["doc_id"]: r["removed"] for r in dedup_lines(frame).collect()}
    assert sum(map(len, once.values())) < sum(map(len, found.values()))


def test_line_dedup_of_short_exact_repeats(spark):
    """Short lines go where they equal an earlier one, also in their own document, never by an edit."""
    rows = [(1, "a short line\n\nother\na short line"), (2, "A short  line\na short lime\n\nother"), (3, "alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup_lines(frame, exact_words=1).collect()
    assert {r["doc_id"]: (r["removed"], r["n_exact"], r["n_near"]) for r in found} == {
        1: ([3], 1, 0), 2: ([0, 3], 2, 0), 3: ([], 0, 0)
    }


def test_language_model(docs):
    train = [t for _, t in PLAIN[:12]]
    plain = brute.KneserNey(train)
    model = language_model.fit(docs.where(F.coalesce(F.col("doc_id") <= PLAIN[11][0], F.lit(False))))
    assert (model.tokens, model.types) == (sum(plain.counts.values()), len(plain.counts))
    ids = sorted([(i, t) for i, t in PLAIN if i is not None])
    scored = language_model.score(docs.where("doc_id is not null"), model)
    for row, (_, text) in zip(sorted(scored.collect(), key=lambda r: r["doc_id"]), ids, strict=True):
        tokens = [*brute.words(text), "</s>"]
        assert row["n_tokens"] == len(tokens)
        assert row["n_known"] == sum(t in plain.counts for t in tokens)
        assert row["score"] == pytest.approx(plain.score(text), rel=1e-9)
        assert row["base_score"] == pytest.approx(plain.base(text), rel=1e-9)


def test_language_model_sums_to_one(docs):
    plain = brute.KneserNey([t for _, t in PLAIN])
    for context in ("<s>", "word3", "a", "never"):
        total = sum(plain.probability(context, w) for w in plain.counts) + plain.probability(context, "never")
        assert total == pytest.approx(1.0)


def test_language_model_with_frequent_contexts(docs, monkeypatch):
    """Frequent contexts and counts above a byte take other paths to the same scores."""
    monkeypatch.setattr(language_model, "MIN_SHARDS", 300)
    rows = docs.sparkSession.createDataFrame([("a b a c " * 400,), ("a a b",), (None,)], "text string")
    model = language_model.fit(rows)
    plain = brute.KneserNey(["a b a c " * 400, "a a b", None])
    assert len(model.heavy) > 1
    for row in language_model.score(rows.withColumn("t", F.col("text")), model).collect():
        assert row["score"] == pytest.approx(plain.score(row["t"]), rel=1e-9)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"), drops_space=True)


TOKEN_TEXTS = ["it's  <|endoftext|>twice", " \n", None, "", "CAFÉ café 12345", "x<|startoftext|>", " em sp", "a\x1cb \x85 c"]


def test_token_counts(spark, docs, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer.content.decode())
    cache = scratch(spark, "cache")
    texts = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TOKEN_TEXTS)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(texts)
    for _ in range(2):  # the second time, everything is known
        for row in count_tokens(frame, tokenizer, cache, limit=60).collect():
            n = len(whole.encode(row["text"] or "", add_special_tokens=False))
            assert (row["n_tokens"], row["over_limit"]) == (n, n > 60)
            assert row["n_bytes"] == len((row["text"] or "").encode())


def test_token_cache_encodes_only_misses(spark, tokenizer, monkeypatch):
    import gleaner.llm.tokens as tokens

    cache, asked, encode = scratch(spark, "cache"), [], tokens.encode_misses
    monkeypatch.setattr(tokens, "encode_misses", lambda m, t: asked.append(m.count()) or encode(m, t))
    one = spark.createDataFrame([("a b",), (" a  b ",), ("c",), (None,)], "text string")
    count_tokens(one, tokenizer, cache)
    count_tokens(one.union(spark.createDataFrame([("d",)], "text string")), tokenizer, cache)
    assert asked == [3, 1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(spark, name):
    import public_tokenizers

    file = TokenizerFile.read(public_tokenizers.path(name))
    frame = spark.createDataFrame([("a  b\n c",), (None,)], "text string")
    counts = [r["n_tokens"] for r in count_tokens(frame, file, scratch(spark, "cache")).collect()]
    assert counts == [file.counter()(["a  b\n c"])[0], 0]


def test_language_by_cross_parsing(spark):
    rows = [(i, "the cat and the dog sat on the mat with that other thing " * 3, "en") for i in range(20)]
    rows += [(100 + i, "der Hund und die Katze liegen auf dem Teppich mit jenem Ding " * 3, "de") for i in range(20)]
    rows += [(200, None, "de"), (201, "12 !?", "en"), (202, "die katze und der hund", None), (203, "the dog and cat", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    found = {r["doc_id"]: r for r in language.identify(frame, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows if lang and i < 200)
    assert [found[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[200]["score"] == 0
    nothing = language.fit(frame.limit(0))
    assert {r["lang_pred"] for r in language.identify(frame, nothing).collect()} == {"und"}


def test_automaton_parses_longest_phrases():
    import numpy as np

    sample = "abracadabra"
    codes = np.array([ord(c) - 95 for c in sample])
    step = language.parser_table(language.automaton(codes))

    def phrases(text):
        count, i = 0, 0
        while i < len(text):
            n = max([k for k in range(1, len(text) - i + 1) if text[i : i + k] in sample], default=1)
            count, i = count + 1, i + n
        return count

    for text in ("abra", "cadab", "abrabra", "zzz", "azbracc", "dabrac"):
        state, found = len(step) - language.SYMBOLS, 0
        for c in text:
            move = int(step[state + ord(c) - 95])
            found, state = found + (move & 1), move >> 1
        assert found == phrases(text)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav>
<article><h1>Title &amp; more</h1><p><b>First   para<br>graph.<p>Second <a href="a>b">one</a> &lt;here&gt;.</p></article>
<footer>&copy; Site"""


def test_blocks_of_a_page():
    blocks = html_text.blocks_of(PAGE)
    assert [b.text for b in blocks] == ["Home", "Title & more", "First para graph.", "Second one <here>.", "© Site"]
    assert html_text.rule_labels(blocks) == [False, True, True, True, False]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == html_text.blocks_of("<div><br></div>") == []
    assert html_text.blocks_of("a < b <3 </nope> c")[0].text == "a < b <3 c"
    assert len(html_text.blocks_of("<p>x" * 5000)) == 5000


def test_extraction_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = html_text.fit(pages)
    rows = pages.collect()
    found = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", F.lit(1)), labeller).collect()}
    wrong = 0
    for row in rows:
        blocks = html_text.blocks_of(row["html"])
        wrong += found[row["page_id"]]["text"] != html_text.main_text(blocks, html_text.rule_labels(blocks))
    assert wrong == 0
    # without the semantic elements, context and words have to do
    bare = [r["html"].replace("article", "div").replace("<nav>", '<div class="menu">').replace("</nav>", "</div>") for r in rows[:80]]
    blocks = [html_text.blocks_of(r["html"]) for r in rows[:80]]
    marks = html_text.label(labeller, [html_text.blocks_of(b) for b in bare])
    right = sum(m == k for b, ms in zip(blocks, marks) for m, k in zip(ms, html_text.rule_labels(b)))
    assert right / sum(map(len, blocks)) > 0.97


PARTS = [
    '<div class="comments"><p>{}</p></div>',
    '<section id="comments"><h3>{}</h3><div class="comment"><p>{}</p></div></section>',
    "<aside><p>{}</p></aside>",
    "<header><p>{}</p></header>",
    '<div class="notice">{}</div>',
    '<div class="cookie-banner"><p>{}</p></div>',
    '<div class="advert">{}</div>',
    '<ul class="related-posts"><li>{}</li></ul>',
    "<form><p>{}</p></form>",
]


def test_parts_inside_the_article_are_left_out(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    labeller = html_text.train(pages[:120])
    text = "Some words that stand in a part of the page which is none of the article."
    wrong = 0
    for part in PARTS:
        held = [p.replace("</article>", part.format(text, text) + "</article>") for p in pages[150:190]]
        blocks = [html_text.blocks_of(p) for p in held]
        wrong += sum(m != html_text.rule_labels(b) for b, m in zip(blocks, html_text.label(labeller, blocks)))
    assert wrong <= 0.02 * 40 * len(PARTS)


def test_extraction_of_awkward_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>alone"), (3, None, "<p>alone"), (None, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract(frame, None).collect()
    assert len(found) == 5
    by_id = {r["page_id"]: r for r in found}
    assert by_id[1]["text"] == by_id[2]["text"] == "" and by_id[1]["n_chars"] == 0
    assert by_id[None]["text"] == "Title & more\n\nFirst para graph.\n\nSecond one <here>."
    assert html_text.extract(frame.limit(0), html_text.fit(frame.limit(0))).count() == 0


def test_targets_share_the_excess():
    assert targets([10, 10, 80], [3, 1, 2], 150, 2) == [20.0, 20.0, 110.0]
    assert targets([0, 10], [3, 1], 15, 2) == [0.0, 15.0]
    assert targets([], [], 0, 2) == []
    assert sum(targets([5, 7, 9, 11], [3, 1, 2, 3], 48, 2)) == pytest.approx(48)


def test_flow_prefers_first_copies():
    patterns = [(frozenset({0}), 10), (frozenset({1}), 10), (frozenset({0, 1}), 10)]
    flow = route(patterns, [18, 12], 2)
    taken = [sum(n for (p, _), n in flow.items() if p == k) for k in range(3)]
    assert sum(taken) == 30 and max(taken) == 10  # both quotas met without a second copy
    flow = route(patterns, [40, 0], 2)
    assert sum(n for (p, s), n in flow.items() if s == 0) == 40
    assert not any(p == 1 for (p, s), n in flow.items())


def test_mixing(docs):
    mixed = mix(docs)
    rows = mixed.collect()
    assert len(rows) == len(ROWS) and sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    sizes = Counter()
    for row in rows:
        assert row["size"] == len(brute.SPACE_WORD.findall(row["text"] or ""))
        assert row["taken"] in (0, row["size"], 2 * row["size"])
        sizes[row["source"]] += row["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(300)]
    rows.append((999, "w w", []))
    mixed = mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert {r["taken"] for r in mixed if r["source"] == []} == {0}
    assert sum(r["taken"] for r in mixed) == pytest.approx(1.5 * 3000, rel=0.02)


DAY = datetime.date(2024, 1, 1)


def _day(n):
    return DAY + datetime.timedelta(n)


LOG = [
    ("l1", "example.com", _day(2), "add", 0),
    ("l1", "example.com", _day(5), "remove", 1),
    ("l1", "example.com", _day(5), "add", 0),
    ("l1", "example.com", _day(9), "add", 2),
    ("l2", "www.example.com/a/b", _day(0), "add", 0),
    ("l3", "com", _day(30), "add", 0),
    (None, "com", _day(0), "add", 0),
    ("l4", None, _day(0), "add", 0),
    ("l5", "com", None, "add", 0),
]
CAPTURES = [
    (i, url, _day(n) if n is not None else None)
    for i, (url, n) in enumerate(
        (u, n)
        for u in (
            "http://example.com/",
            "https://User@WWW.Example.com.:8080/a/b/c?d#e",
            "http://www.example.com/a/bc",
            "http://notexample.com/a",
            None,
            "",
            "no url",
        )
        for n in (0, 2, 4, 5, 9, 31, None)
    )
]


def test_url_lists(spark):
    log = spark.createDataFrame(LOG, "list string, pattern string, day date, action string, seq int")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_on date").withColumn("lists", F.lit(1))
    assert {(r["list"], r["valid_from"], r["valid_to"]) for r in intervals(log).collect() if r["pattern"] == "example.com"} == {
        ("l1", _day(2), _day(5)),
        ("l1", _day(9), datetime.date(9999, 12, 31)),
    }
    for row in judge(captures.union(captures.limit(3)), log).collect():
        host = {"http://example.com/": "example.com", "http://notexample.com/a": "notexample.com"}.get(
            row["url"], "www.example.com" if row["url"] and "xample" in row["url"] else None
        )
        assert row["host"] == host
        n = None if row["fetched_on"] is None else (row["fetched_on"] - DAY).days
        expected = set()
        if host and n is not None:
            if host.endswith("example.com") and host != "notexample.com" and (2 <= n < 5 or n >= 9):
                expected.add("l1")
            if row["url"].endswith("/a/b/c?d#e"):
                expected.add("l2")
            if n >= 30:
                expected.add("l3")
        assert row["lists"] == ",".join(sorted(expected)) and row["blocked"] == bool(expected)


def test_hosts(spark):
    urls = ["HTTP://A.B/", "ftp://u:p@h.x:1/", "http://h..", "http:///x", "//h/x", None, "http://h?x"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r["h"] for r in frame.collect()] == ["a.b", "h.x", "h", None, None, None, "h"]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id int, text string")
    assert cascade(empty).count() == text_measures(empty).count() == 0
    assert contaminated(empty, items).count() == 0
    assert ngram_jaccard(empty).count() == one_of_each(empty).count() == 0
    assert dedup_lines(empty).count() == 0
    assert mix(empty).count() == 0
    model = language_model.fit(empty)
    assert language_model.score(empty, model).count() == 0
    log = spark.createDataFrame([], "list string, pattern string, day date, action string, seq int")
    captures = spark.createDataFrame([], "url string, fetched_on date")
    assert judge(captures, log).count() == 0


def test_nothing_to_compare_with(spark, docs, empty):
    items = spark.createDataFrame([], "item_id int, text string")
    assert {r["n_hit"] for r in contaminated(docs, items).collect()} == {0}
    scored = language_model.score(docs, language_model.fit(empty)).collect()
    assert {r["score"] for r in scored} == {0.0} and {r["train_tokens"] for r in scored} == {0}
    log = spark.createDataFrame([], "list string, pattern string, day date, action string, seq int")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_on date")
    assert {r["blocked"] for r in judge(captures, log).collect()} == {False}
