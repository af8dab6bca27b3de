"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONTENT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE_WORD.findall(lower(text))


def shingles(text, n):
    ws = words(text)
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset()


def components(rows, n, percent):
    """For each row of (doc_id, text) the set of row places it is connected with."""
    sets = [shingles(text, n) for _, text in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    return sets, [[j for j in range(len(rows)) if find(j) == find(i)] for i in range(len(rows))]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def removed_lines(rows, min_words):
    """For each (doc_id, text) the numbers of lines equal or one word away from an earlier one."""
    lines = []
    for at, (_, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            ws = words(line)
            if len(ws) >= min_words:
                lines.append((at, k, ws))
    gone = defaultdict(list)
    for i, (at, k, ws) in enumerate(lines):
        if any(edit_distance(ws, other) <= 1 for _, _, other in lines[:i]):
            gone[at].append(k)
    return [gone[at] for at in range(len(rows))]


def hits(text, items, window=10):
    """(words, hit words, ids of items with an occurring window)."""
    ws = CONTENT_WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        iw = CONTENT_WORD.findall(lower(item))
        n = min(window, len(iw))
        if not n:
            continue
        spans = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in spans:
                hit.update(range(i, i + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(ws), len(hit), sorted(found)


class KneserNey:
    """Interpolated modified Kneser-Ney over bigrams of texts closed by an end token."""

    def __init__(self, texts):
        self.counts, self.pairs = Counter(), Counter()
        for text in texts:
            tokens = [*words(text), "</s>"]
            self.counts.update(tokens)
            self.pairs.update(zip(["<s>", *tokens[:-1]], tokens))
        self.after = Counter(b for _, b in self.pairs)
        self.context, self.kinds = Counter(), defaultdict(Counter)
        for (a, _), n in self.pairs.items():
            self.context[a] += n
            self.kinds[a][min(n, 3)] += 1
        self.upper, self.lower = self._discounts(self.pairs), self._discounts(self.after)
        kinds = Counter(min(n, 3) for n in self.after.values())
        self.spare = sum(self.lower[k] * kinds[k] for k in (1, 2, 3)) / max(1, len(self.pairs))

    @staticmethod
    def _discounts(counter):
        n = [sum(v == k for v in counter.values()) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]

    def probability(self, a, b):
        n = self.after.get(b, 0)
        low = max(n - self.lower[min(n, 3)], 0) / max(1, len(self.pairs)) + self.spare / (len(self.counts) + 1)
        if not self.context.get(a):
            return low
        n = self.pairs.get((a, b), 0)
        mass = sum(self.upper[k] * self.kinds[a][k] for k in (1, 2, 3))
        return (max(n - self.upper[min(n, 3)], 0) + mass * low) / self.context[a]

    def score(self, text):
        tokens = [*words(text), "</s>"]
        return sum(math.log10(self.probability(a, b)) for a, b in zip(["<s>", *tokens[:-1]], tokens))

    def base(self, text):
        total, kinds = sum(self.counts.values()), len(self.counts)
        return sum(
            math.log10((self.counts.get(t, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for t in [*words(text), "</s>"]
        )
