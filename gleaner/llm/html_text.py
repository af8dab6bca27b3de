"""Main text of web pages: a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path of open elements.
Each block becomes a vector of hashed path tokens, hashed words and a few measures, and a
bidirectional LSTM in numpy reads a page's blocks in order and labels each with the whole page as
context. The text is the blocks labelled main, joined by blank lines.

The labeller is trained here, on a bounded sample: ``TRAIN_PAGES`` pages chosen by a hash of their id,
without those of more than ``TRAIN_BLOCKS`` blocks, labelled by their own semantic elements (main text stands in article or main, and in none of the
parts that the lexicon below names). Each is also shown with those elements renamed or nameless, and
with parts that a lexicon describes put in, so that no single tag decides.

Defined results: null, empty and block-less pages have an empty text; repeated rows get the same
text; with no page to learn from, the rule that labels the sample stands in for the labeller; columns
of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.shared import require, ship, shipped, small_batches
from gleaner.llm.words import word_chunks

TRAIN_PAGES = 120
TRAIN_BLOCKS = 150  # longer pages are not trained on
PATH_SLOTS = 128
WORD_SLOTS = 32
MEASURES = 11
HIDDEN = 16
EPOCHS = 16

# Elements that end a block, elements whose content is no text of the page, elements
# that have no end tag, and words that name the parts of a page in tags, classes, ids and roles.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset(
    "button canvas datalist head iframe input math noscript object script select style svg template textarea title".split()
)
RAW_TAGS = frozenset("script style textarea title iframe noscript template svg select math canvas object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_WORDS = ("article", "main", "articlebody")
OTHER_WORDS = (
    "nav navbar navigation menu header masthead footer aside sidebar ad ads advert advertisement sponsored promo banner "
    "cookie consent notice alert popup modal form login signup newsletter subscribe search share social related "
    "recommended breadcrumb breadcrumbs pagination pager widget comment comments respond reply disqus copyright"
).split()
_OTHER, _MAIN = frozenset(OTHER_WORDS), frozenset(MAIN_WORDS)
PLAIN_WORDS = ("content", "post", "entry", "story", "text", "body", "page", "wrapper", "container")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|([^<]++)|<", re.S
)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


@dataclass(frozen=True)
class Block:
    """Text of one leaf block and the tokens of the elements around it, outermost first."""

    text: str
    path: tuple[str, ...]
    linked: float


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """Tokens of a tag: its name, and the words of its class, id, role and itemprop.

    What the root and the body are called says nothing about a part of the page.
    """
    if not attributes or tag in ("html", "body"):
        return (tag,)
    words = []
    for match in _NAMED.finditer(attributes):
        value = match[1] or match[2] or match[3] or ""
        words += [w.lower() for w in _WORD.findall(value)]
        words += [w.lower() for w in value.split()]
    return (tag, *dict.fromkeys(words))


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; markup may be broken."""
    page = page or ""
    found: list[Block] = []
    open_: list[tuple[str, tuple[str, ...], bool]] = []
    silent = links = 0
    parts: list[str] = []
    in_links = 0

    def close() -> None:
        nonlocal in_links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            path = tuple(name for _, names, _ in open_ for name in names)
            found.append(Block(text, path, min(1.0, in_links / len(text))))
        parts.clear()
        in_links = 0

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        end, tag, attributes, text = match[1], match[2], match[3], match[4]
        if tag is None:
            if text is None and match[0] == "<":
                text = "<"
            if text is not None and not silent:
                parts.append(text)
                in_links += len(text) if links else 0
            continue
        tag = tag.lower()
        if end:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if depth is None:
                if tag == "p" and not silent:
                    close()
                continue
            if any(t in BLOCK_TAGS for t, _, _ in open_[depth:]):
                close()
            for t, _, quiet in open_[depth:]:
                silent -= quiet
                links -= t == "a"
            del open_[depth:]
            continue
        if tag in RAW_TAGS and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            # a paragraph, list item or cell ends where the next one begins
            for i in range(len(open_) - 1, -1, -1):
                outer = open_[i][0]
                if outer == "p" or (outer == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    for t, _, quiet in open_[i:]:
                        silent -= quiet
                        links -= t == "a"
                    del open_[i:]
                    break
                if outer in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS:
            continue
        # a form inside the article is none of its text; one around it is a container
        quiet = tag in SILENT_TAGS or (tag == "form" and any(not _MAIN.isdisjoint(n) for _, n, _ in open_))
        open_.append((tag, _names(tag, attributes), quiet))
        silent += quiet
        links += tag == "a"
    close()
    return found


def rule_labels(blocks: Sequence[Block]) -> list[bool]:
    """What a page's own elements say: inside main or article, and in no part named otherwise."""
    return [not _MAIN.isdisjoint(b.path) and _OTHER.isdisjoint(b.path) for b in blocks]


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


def features(pages: Sequence[Sequence[Block]]) -> np.ndarray:
    """A vector per block, pages after one another."""
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), PATH_SLOTS + WORD_SLOTS + MEASURES), np.float32)
    slots: dict[tuple[str, ...], list[int]] = {}
    for i, block in enumerate(blocks):
        at = slots.get(block.path)
        if at is None:
            at = slots[block.path] = [_slot(t, PATH_SLOTS) for t in block.path[-24:]]
        out[i, at] = 1.0
    for first, last, words, bounds in word_chunks(pa.array([b.text for b in blocks], pa.large_string())):
        owner = np.repeat(np.arange(first, last), np.diff(bounds))
        np.add.at(out, (owner, PATH_SLOTS + (words % np.uint64(WORD_SLOTS)).astype(np.int64)), 1.0)
        count = np.maximum(np.diff(bounds), 1)[:, None]
        out[first:last, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] /= np.sqrt(count)
        out[first:last, -1] = np.log1p(np.diff(bounds)) / 5
    at = 0
    for page in pages:
        n = len(page)
        place = np.arange(n, dtype=np.float32) / max(1, n - 1)
        out[at : at + n, -2] = place
        out[at : at + n, -3] = 1.0 - place
        at += n
    out[:, -4] = [b.linked for b in blocks]
    out[:, -5] = [min(1.0, len(b.text) / 200) for b in blocks]
    out[:, -6] = [b.text[-1] in ".!?" for b in blocks]
    out[:, -7] = ["©" in b.text for b in blocks]
    out[:, -8] = 1.0
    # how often the lexicon's words stand around the block, and whether one of them is innermost
    out[:, -9] = [0.0 if _OTHER.isdisjoint(b.path) else 1.0 for b in blocks]
    out[:, -10] = [0.0 if _MAIN.isdisjoint(b.path) else 1.0 for b in blocks]
    out[:, -11] = [1.0 if not _OTHER.isdisjoint(b.path[-3:]) else 0.0 for b in blocks]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with one output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = PATH_SLOTS + WORD_SLOTS + MEASURES
        self.weights: dict[str, np.ndarray] = {}
        for way in "fb":
            self.weights[f"x{way}"] = rng.normal(0, 0.1, (width, 4 * HIDDEN)).astype(np.float32)
            self.weights[f"h{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.weights[f"c{way}"] = bias
        self.weights["out"] = rng.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)

    @staticmethod
    def _order(lengths: np.ndarray, way: str, t: int, lanes: int) -> np.ndarray:
        """The block that each running lane reads at step ``t``, within its page."""
        return np.full(lanes, t) if way == "f" else lengths[:lanes] - 1 - t

    def _run(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of all blocks; lanes are pages, longest first, so those still running lead."""
        wx, wh, bias = (self.weights[k + way] for k in "xhc")
        out = np.zeros((len(x), HIDDEN), np.float32)
        h = c = np.zeros((len(lengths), HIDDEN), np.float32)
        running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        drive = x @ wx + bias
        for t, lanes in enumerate(running.tolist()):
            at = starts[:lanes] + self._order(lengths, way, t, lanes)
            gates = drive[at] + h[:lanes] @ wh
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before_h, before_c = h[:lanes], c[:lanes]
            c = f * before_c + i * g
            tanh_c = np.tanh(c)
            h = o * tanh_c
            out[at] = h
            if keep is not None:
                keep.append((at, i, f, o, g, before_h, before_c, tanh_c))
        return out

    def logits(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, starts, lengths, way, None) for way in "fb"], 1)
        return (both @ self.weights["out"])[:, 0] + self.weights["bias"][0]

    def gradients(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, starts, lengths, way, kept[way]) for way in "fb"], 1)
        error = ((_sigmoid((both @ self.weights["out"])[:, 0] + self.weights["bias"][0]) - y) / len(y))[:, None].astype(np.float32)
        grads = {"out": both.T @ error, "bias": error.sum(0)}
        back = error @ self.weights["out"].T
        for k, way in enumerate("fb"):
            wh = self.weights[f"h{way}"]
            into = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            d_gates = np.zeros((len(x), 4 * HIDDEN), np.float32)
            d_wh = np.zeros_like(wh)
            dh = dc = np.zeros((0, HIDDEN), np.float32)
            for at, i, f, o, g, before_h, before_c, tanh_c in reversed(kept[way]):
                more = np.zeros((len(at) - len(dh), HIDDEN), np.float32)
                dh = np.concatenate([dh, more]) + into[at]
                dc = np.concatenate([dc, more]) + dh * o * (1 - tanh_c**2)
                gate = np.concatenate(
                    [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1
                )
                d_gates[at] = gate
                d_wh += before_h.T @ gate
                dh, dc = gate @ wh.T, dc * f
            grads |= {f"x{way}": x.T @ d_gates, f"h{way}": d_wh, f"c{way}": d_gates.sum(0)}
        return grads


def _laid_out(pages: Sequence[Sequence[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in page order, and for lanes in order of falling length their starts and lengths."""
    lengths = np.array([len(p) for p in pages], np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    return features(pages), starts[order], lengths[order]


def label(labeller: Labeller | None, pages: Sequence[Sequence[Block]]) -> list[list[bool]]:
    """For each page which blocks are main text."""
    if labeller is None:
        return [rule_labels(p) for p in pages]
    if not any(pages):
        return [[] for _ in pages]
    main = labeller.logits(*_laid_out(pages)) > 0
    ends = np.cumsum([len(p) for p in pages])[:-1]
    return [part.tolist() for part in np.split(main, ends)]


def _variants(
    blocks: Sequence[Block], labels: Sequence[bool], strangers: Sequence[str], rng: np.random.Generator
) -> Iterator[tuple[list[Block], list[bool]]]:
    """The page as it is, with renamed elements, and with foreign parts put in."""
    yield list(blocks), list(labels)
    for named in (True, False):
        plain = PLAIN_WORDS[rng.integers(len(PLAIN_WORDS))]
        other = OTHER_WORDS[rng.integers(len(OTHER_WORDS))]
        swap = {w: (plain if named else "div") for w in MAIN_WORDS}
        swap |= {w: (other if rng.random() < 0.8 else "div") for w in OTHER_WORDS}
        page, good = [], []
        for block, keep in zip(blocks, labels):
            if not named and not keep and block.linked < 0.5:
                path = block.path  # without names only links and context tell; keep what was said
            else:
                path = tuple(dict.fromkeys(swap.get(t, t) for t in block.path))
            page.append(Block(block.text, path, block.linked))
            good.append(keep)
        for _ in range(int(rng.integers(2, 6))):
            word = OTHER_WORDS[rng.integers(len(OTHER_WORDS))]
            at = int(rng.integers(len(page) + 1))
            near = page[min(at, len(page) - 1)].path
            tag = ("div", "section", "aside", "ul", word)[int(rng.integers(5))]
            outer = near[:-1] if rng.random() < 0.6 else near[:2]
            inner = ((), ("p",), ("div", "p"), ("li",))[int(rng.integers(4))]
            for _ in range(int(rng.integers(1, 4))):
                text = strangers[int(rng.integers(len(strangers)))]
                page.insert(at, Block(text, tuple(dict.fromkeys((*outer, tag, word, *inner))), 0.0))
                good.insert(at, False)
        yield page, good


def train(pages: Sequence[str], seed: int = 5) -> Labeller | None:
    """A labeller from pages whose elements tell main text; None if there are none."""
    rng = np.random.default_rng(seed)
    known = []
    for page in pages:
        blocks = blocks_of(page)
        labels = rule_labels(blocks)
        if any(labels) and len(blocks) <= TRAIN_BLOCKS:
            known.append((blocks, labels))
    if not known:
        return None
    texts = sorted({b.text for blocks, _ in known for b in blocks})
    samples = [v for blocks, labels in known for v in _variants(blocks, labels, texts, rng)]
    samples.sort(key=lambda s: len(s[0]))
    batches = []
    for at in range(0, len(samples), 48):
        part = samples[at : at + 48]
        batches.append((*_laid_out([b for b, _ in part]), np.concatenate([np.array(y, np.float32) for _, y in part])))
    model = Labeller(seed)
    mean = {k: np.zeros_like(w) for k, w in model.weights.items()}
    square = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(batches)).tolist():
            step += 1
            for k, g in model.gradients(*batches[at]).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                fall = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] = (model.weights[k] - 0.01 * fall).astype(np.float32)
    return model


def fit(pages: DataFrame) -> Labeller | None:
    """Train on the bounded sample of ``pages`` (``page_id``, ``html``)."""
    require(pages, "page_id", "html")
    known = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull())
    ranked = known.select("page_id").distinct().orderBy(F.xxhash64(F.lit(3), "page_id"), "page_id").limit(TRAIN_PAGES)
    ids = [r["page_id"] for r in ranked.collect()]
    if not ids:
        return None
    rows = known.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html"))
    return train([r["html"] for r in sorted(rows.collect(), key=lambda r: str(r["page_id"]))])


def main_text(blocks: Sequence[Block], main: Sequence[bool]) -> str:
    return "\n\n".join(b.text for b, keep in zip(blocks, main, strict=True) if keep)


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """``pages`` without ``html``, with ``text``, ``n_chars``, ``n_blocks`` and ``n_main``."""
    require(pages, "html")
    small_batches(pages.sparkSession)
    own = ("text", "n_chars", "n_blocks", "n_main")
    given = pages.select(*[c for c in pages.columns if c not in own])
    carried = [f for f in given.schema.fields if f.name != "html"]
    shared = ship(pages.sparkSession, labeller)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(page) for page in batch.column("html").to_pylist()]
            marks = label(shipped(shared), found)
            texts = [main_text(b, m) for b, m in zip(found, marks, strict=True)]
            columns = [batch.column(f.name) for f in carried]
            columns += [
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(b) for b in found], pa.int64()),
                pa.array([sum(m) for m in marks], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in carried] + list(own))

    schema = given.select(*[f.name for f in carried], F.lit("").alias("text"), *[F.lit(0).cast("long").alias(c) for c in own[1:]]).schema
    return given.mapInArrow(read, schema)
