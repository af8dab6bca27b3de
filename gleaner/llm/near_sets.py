"""N-gram Jaccard join by signature trees.

Texts become sets of hashed word n-grams; equal sets are one. Two sets that are similar enough share
a shingle among the rarest few of each (the prefix of a common order), so sets meet in groups by
prefix shingle. The order puts rare shingles first, by counts over all texts in a fixed number of
buckets, which keeps passages that many documents share out of the prefixes.

Within a group a signature tree is built: leaves hold sets of like size, every node the OR of its
sets' token bitmaps, their size range and how many tokens may share a bit. Traversals of the
tree against itself drop node pairs whose largest possible overlap is too small. Sets for which a pair
is left are made again whole and compared exactly. Groups with the same smallest member mostly belong
to one family of near copies; they are worked on in one unit, where a set is brought once and a pair is
compared once, and never written; a family above ``UNIT`` tokens is dealt to several units.

Links only matter up to connection. A family's sets are first linked to leaders; then all pairs of
sets that are not connected are looked at, so a group of thousands of near copies is not
expanded into all pairs, and no link between different components is lost. Groups above
``BLOCK`` members are worked on in pairs of blocks.

Defined results: null and empty texts have an empty set and are linked with nothing; a text with
fewer words than ``n`` is one shingle; a null ``doc_id`` takes part but names no component unless
all of its component's are null; repeated rows are one set; empty tables give empty results. Columns
of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.bloom import bloom_of, may_hold
from gleaner.llm.components import components
from gleaner.llm.shared import require, small_batches, written
from gleaner.llm.words import deal, gram_hashes, joined, shard_of, word_chunks

BUCKET_BITS = 20  # of the shingle counts that order the prefixes
PART_BITS = 14  # buckets that are added up together
BITS_PER_TOKEN = 4  # of a signature, rounded up to a power of two within these bounds
FEWEST_BITS, MOST_BITS = 512, 1 << 16
LEAF = 16
FAN = 8
BLOCK = 4096
SHARD_POSTINGS = 4_000_000
HELD_WORDS = 1 << 22  # of signatures compared at a time
UNIT = 2_000_000  # tokens of the sets that are compared and verified together
FIRST_PAIRS, HELD_PAIRS = 256, 65_536  # compared at a time, after which connected ones are left out
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for first, last, words, bounds in word_chunks(texts):
        grams = gram_hashes(words, n)
        for i in range(last - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets have a shingle in each bucket, over all texts; a table of fixed size."""
    parts = 1 << (BUCKET_BITS - PART_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            found = np.concatenate([np.empty(0, np.uint64), *shingle_sets(batch.column("text"), n)])
            counts += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        for part, c in enumerate(np.split(counts, parts)):
            if c.any():
                few = np.minimum(c, 0xFFFFFFFF).astype(np.uint32)  # of one task
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [few.tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in group["counts"].to_pylist())
        return pa.table({"part": group["part"].slice(0, 1), "counts": [total.tobytes()]})

    schema = "part int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema)
    counts = np.zeros((parts, 1 << PART_BITS), np.int64)
    for row in summed.collect():  # at most ``parts`` rows
        counts[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return counts.ravel()


def prefix_of(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, as many that two sets of the given similarity share one.

    The order is by count, then by hash, packed into one number; where packed numbers tie at the
    end, all of them are taken, so every set cuts alike.
    """
    size = len(shingles)
    keep = size - (percent * size + 99) // 100 + 1
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    rank = np.minimum(counts[bucket], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
    rank |= (shingles & np.uint64((1 << 60) - 1)) >> np.uint64(20)
    return shingles[rank <= np.partition(rank, keep - 1)[keep - 1]]


def signature_of(shingles: np.ndarray) -> bytes:
    """A bitmap of the low hash bits; sets of like size have bitmaps of like width."""
    width = 1 << (BITS_PER_TOKEN * len(shingles) - 1).bit_length()
    width = max(FEWEST_BITS, min(MOST_BITS, width))
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def widened(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures as bit words of one width, how many bits each had set, and how often it is repeated.

    A narrow one is repeated: it then says of every wider hash whether its low bits occur, so an
    overlap is never taken for less than it may be.
    """
    words = [np.frombuffer(signature, np.uint64) for signature in signatures]
    width = max(map(len, words))
    own = np.array([int(popcount(w)) for w in words])
    return np.stack([np.tile(w, width // len(w)) for w in words]), own, np.array([width // len(w) for w in words])


def profiles(keyed: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``(key, sid, size, prefix, signature)`` of non-empty texts, at least once for each key.

    A task gives the prefix and the signature of a set once.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(counts)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        given: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            keys = batch.column("key").to_pylist()
            for key, shingles in zip(keys, shingle_sets(batch.column("text"), n), strict=True):
                if len(shingles) and key not in seen:
                    seen.add(key)
                    sid, prefix, signature = _digest(shingles), b"", b""
                    if sid not in given:
                        given.add(sid)
                        prefix = prefix_of(shingles, shared.value, percent).tobytes()
                        signature = signature_of(shingles)
                    out.append((key, sid, len(shingles), prefix, signature))
            if out:
                names = ("key", "sid", "size", "prefix", "signature")
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    return keyed.mapInArrow(profile, "key binary, sid binary, size long, prefix binary, signature binary")


def popcount(words: np.ndarray) -> np.ndarray:
    """Set bits along the last axis of bit words."""
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


class SignatureTree:
    """Sets in order of size, grouped into leaves and upward; each level knows what it may overlap."""

    def __init__(self, sizes: np.ndarray, signatures: list[bytes], component: np.ndarray):
        bits, own, self.repeats = widened(signatures)
        spare = sizes - own  # tokens that share a bit with another of the same set
        self.levels = [(bits, sizes, sizes, spare, component, component)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, s, c0, c1 = self.levels[-1]
            cut = np.arange(0, len(lo), step)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, cut, axis=0),
                    np.minimum.reduceat(lo, cut),
                    np.maximum.reduceat(hi, cut),
                    np.maximum.reduceat(s, cut),
                    np.minimum.reduceat(c0, cut),
                    np.maximum.reduceat(c1, cut),
                )
            )
            step = FAN

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether node pairs may hold a link: by component, by size, by largest possible overlap."""
        bits, lo, hi, spare, c0, c1 = self.levels[level]
        apart = ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
        apart &= (hi[i] * 100 >= lo[j] * percent) & (hi[j] * 100 >= lo[i] * percent)
        i, j = i[apart], j[apart]
        both = popcount(bits[i] & bits[j]) + np.minimum(spare[i], spare[j])
        both = np.minimum(both, np.minimum(hi[i], hi[j]))
        if level == 0:
            # a bit that one of two sets has is a token that the other lacks, counted once for its repeats;
            # bitmaps of unlike width say nothing of that
            lacking = popcount(bits[i] ^ bits[j]) // self.repeats[i]
            lacking = np.where(self.repeats[i] == self.repeats[j], lacking, 0)
            both = np.minimum(both, (lo[i] + lo[j] - lacking) // 2)
        apart[apart] = both * (100 + percent) >= (lo[i] + lo[j]) * percent
        return apart

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets of different components whose largest possible overlap is enough."""
        top = len(self.levels) - 1
        most = max(FAN * FAN, HELD_WORDS // self.levels[0][0].shape[1])  # compared at a time
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > most:
                half = len(i) // 2
                stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            if level == 0:
                low = i < j
                i, j = i[low], j[low]
            keep = self.may_link(level, i, j, percent) if len(i) else np.empty(0, bool)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            fan = LEAF if level == 1 else FAN
            below = len(self.levels[level - 1][1])
            a, b = (g.ravel() for g in np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"))
            ci = (i[:, None] * fan + a[None, :]).ravel()
            cj = (j[:, None] * fan + b[None, :]).ravel()
            inside = (ci < below) & (cj < below) & (ci <= cj)
            stack.append((level - 1, ci[inside], cj[inside]))

    def leader_pairs(self, percent: int, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each set once with a leader it may be linked to; a set without one leads itself.

        Leaders are taken in ``order``. An order that is the same in all groups makes the same few
        sets lead the many groups of one family of near copies.
        """
        left = order
        while len(left) > 1:
            rest = left[1:]
            near = self.may_link(0, np.full(len(rest), left[0]), rest, percent)
            if near.any():
                yield int(left[0]), rest[near]
            left = rest[~near]


def _postings(shards: int):
    """Prefix shingles with the digest and size of their set, dealt by shingle."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            if not prefixes:
                continue
            reps = np.array([len(p) for p in prefixes])
            keys = np.concatenate(prefixes)
            sids = np.frombuffer(b"".join(batch.column("sid").to_pylist()), np.uint64).reshape(-1, 2)
            sizes = batch.column("size").to_numpy().astype(np.uint32)
            rows = list(deal(shard_of(keys, shards), keys, np.repeat(sids, reps, axis=0), np.repeat(sizes, reps)))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([s for s, _ in rows], pa.int32()),
                    **{name: [c[k] for _, c in rows] for k, name in enumerate(("keys", "sids", "sizes"))},
                }
            )

    return emit


def _blocks(sids: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """A group, or for a large one every pair of its blocks that may hold a link."""
    if len(sids) <= BLOCK:
        yield sids
        return
    half = BLOCK // 2
    cut = range(0, len(sids), half)
    for x, a in enumerate(cut):
        for b in cut[x + 1 :]:
            if b == a + half or sizes[a + half - 1] * 100 >= sizes[b] * percent:
                yield np.concatenate([sids[a : a + half], sids[b : b + half]])


def _runs(percent: int):
    """Groups of two sets or more that share a prefix shingle, once for each list of members."""

    def group(table: pa.Table) -> pa.Table:
        keys = joined(table["keys"].to_pylist(), np.uint64)
        sids = joined(table["sids"].to_pylist(), np.uint64).reshape(-1, 2)
        sizes = joined(table["sizes"].to_pylist(), np.uint32).astype(np.int64)
        order = np.argsort(keys)
        shared = np.concatenate([[False], np.diff(keys[order]) == 0])
        shared[:-1] |= shared[1:]
        order = order[shared]  # the others have one set only
        keys, sids, sizes = keys[order], sids[order], sizes[order]
        order = np.lexsort((sids[:, 1], sids[:, 0], sizes, keys))
        keys, sids, sizes = keys[order], sids[order], sizes[order]
        if len(keys):
            other = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]).any(axis=1)])
            keys, sids, sizes = keys[other], sids[other], sizes[other]
        # a group also ends where the next size is too far away to be linked
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sizes[:-1] * 100 < sizes[1:] * percent)])[: len(keys)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(keys))[: len(begin)]
        many = end - begin > 1
        found: dict[bytes, bytes] = {}
        for a, b in zip(begin[many].tolist(), end[many].tolist()):
            for members in _blocks(sids[a:b], sizes[a:b], percent):
                data = members.tobytes()
                found.setdefault(hashlib.blake2b(data, digest_size=16).digest(), data)
        lists = [[data[i : i + 16] for i in range(0, len(data), 16)] for data in found.values()]
        return pa.table({"run": pa.array(list(found), pa.binary()), "sids": pa.array(lists, pa.list_(pa.binary()))})

    return group


def _asking(percent: int):
    """Members of a partition's runs, which come sorted by unit, family and run, that may have a link.

    Each comes once for its family. A run tells who may be linked, not with whom, so what is handed on grows
    with the members, however many of their pairs stay undecided.
    """

    def may_have_links(run: list[tuple], asked: set[bytes]) -> None:
        run.sort(key=lambda r: (r[1], r[0]))
        sids = np.array([r[0] for r in run], object)
        near = np.array([sid in asked for sid in sids])
        if near.all():
            return
        sizes, signatures = np.array([r[1] for r in run], np.int64), [r[2] for r in run]
        # one set stands for most of a family of near copies; two that are asked for already need not be told apart
        first, others = np.split(np.argsort(sids), [1])
        tree = SignatureTree(sizes, signatures, np.arange(len(run)))
        others = others[tree.may_link(0, np.repeat(first, len(others)), others, percent)]
        near[others] = True
        near[first] |= len(others) > 0
        tree = SignatureTree(sizes, signatures, np.where(near, -1, np.arange(len(run))))
        for i, j in tree.pairs(percent):
            near[i] = near[j] = True
            if near.all():
                break
        asked.update(sids[near])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = key = None
        run: list[tuple] = []
        asked: set[bytes] = set()

        def emit() -> pa.RecordBatch:
            unit, family = place
            columns = {"unit": pa.array([unit] * len(asked), pa.int64()), "family": [family] * len(asked)}
            return pa.RecordBatch.from_pydict(columns | {"sid": pa.array(list(asked), pa.binary())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "family", "run", "sid", "size", "signature")]
            for unit, family, next_key, *member in zip(*columns):
                if next_key != key or (unit, family) != place:
                    if len(run) > 1:
                        may_have_links(run, asked)
                    run = []
                    if (unit, family) != place:
                        if asked:
                            yield emit()
                            asked.clear()
                        place = unit, family
                    key = next_key
                run.append(tuple(member))
        if len(run) > 1:
            may_have_links(run, asked)
        if asked:
            yield emit()

    return asking


class Overlaps:
    """Counts of common tokens of pairs of sets, which are held as numbers of their tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        tokens, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(tokens), bool)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The overlap of each pair; those of one ``i`` are looked up together."""
        out = np.empty(len(i), np.int64)
        order = np.argsort(i, kind="stable")
        cut = np.flatnonzero(np.diff(i[order])) + 1
        for some in np.split(order, cut) if len(order) else ():
            own = self.flat[self.start[i[some[0]]] :][: self.sizes[i[some[0]]]]
            self.mark[own] = True
            lengths = self.sizes[j[some]]
            first = np.cumsum(lengths) - lengths
            places = np.repeat(self.start[j[some]] - first, lengths) + np.arange(lengths.sum())
            out[some] = np.add.reduceat(self.mark[self.flat[places]], first, dtype=np.int64)
            self.mark[own] = False
        return out


def spanning_links(sids: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of non-empty sets that are similar enough: those that connect what all such pairs connect.

    Each set is first compared with a leader, then with the sets it is not connected with yet, so near copies
    are not compared pair by pair.
    """
    if len(sets) < 2:
        return []
    overlaps, found = Overlaps(sets), []
    sizes, signatures = overlaps.sizes, [signature_of(s) for s in sets]
    order = np.array(sorted(range(len(sids)), key=lambda k: (sizes[k], sids[k])), np.int64)
    sizes, signatures = sizes[order], [signatures[k] for k in order]
    label = np.arange(len(sids))  # of the connected part, by places in ``order``

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        step = FIRST_PAIRS
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            x, y, i, j = i[:step], j[:step], i[step:], j[step:]
            both = overlaps.of(order[x], order[y])
            linked = 100 * both >= percent * (sizes[x] + sizes[y] - both)
            for a, b in zip(x[linked].tolist(), y[linked].tolist()):
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    found.append((int(order[a]), int(order[b])))
            step = min(2 * step, HELD_PAIRS)

    tree = SignatureTree(sizes, signatures, label)
    by_sid = np.array(sorted(range(len(sids)), key=lambda k: sids[order[k]]), np.int64)
    for leader, near in tree.leader_pairs(percent, by_sid):
        compare(np.full(len(near), leader), near)
    if len(sids) > 2 and (label != label[0]).any():
        for i, j in SignatureTree(sizes, signatures, label.copy()).pairs(percent):
            compare(i, j)
    return found


def _whole_sets(texts: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """``(sid, blob)``: the hashes of at least the needed sets, made again from the texts.

    A Bloom filter of fixed size keeps most other sets out; the join that follows is exact. A set
    comes once from each task that reads a text of it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bloom_of(needed, "sid"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sids, blobs = [], []
            for shingles in shingle_sets(batch.column("text"), n):
                sid = _digest(shingles)
                if sid not in seen and may_hold(shared.value, sid):
                    seen.add(sid)
                    sids.append(sid)
                    blobs.append(shingles.tobytes())
            if sids:
                yield pa.RecordBatch.from_pydict({"sid": sids, "blob": blobs})

    return texts.mapInArrow(again, "sid binary, blob binary")


def verified(asked: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between the asked ``(unit, family, sid)`` that connect what all links connect.

    A unit's families are compared together on whole sets, so a set is brought once to a unit, and a pair
    exists only while it is compared. What a unit connects is handed on as a star, which ``components`` joins
    in fewer steps than the links themselves.
    """
    asked = written(asked, "asked")
    blobs = _whole_sets(texts, asked.select("sid").distinct(), n)

    def check(some: pa.Table, sets: pa.Table) -> pa.Table:
        held = {
            sid: np.frombuffer(blob, np.uint64)
            for sid, blob in zip(sets["sid"].to_pylist(), sets["blob"].to_pylist())
        }
        families: dict[bytes, list[bytes]] = {}
        for family, sid in zip(some["family"].to_pylist(), some["sid"].to_pylist()):
            families.setdefault(family, []).append(sid)
        above: dict[bytes, bytes] = {}  # a smaller set that one is connected with

        def smallest(sid: bytes) -> bytes:
            path = []
            while sid in above:
                path.append(sid)
                sid = above[sid]
            above.update(dict.fromkeys(path, sid))
            return sid

        for sids in families.values():
            for x, y in spanning_links(sids, [held[sid] for sid in sids], percent):
                a, b = sorted((smallest(sids[x]), smallest(sids[y])))
                if a != b:
                    above[b] = a
        ends = list(above)
        return pa.table({"a": pa.array(map(smallest, ends), pa.binary()), "b": pa.array(ends, pa.binary())})

    # With few askers the sets go straight to the units; otherwise they are shuffled on the way.
    places = asked.select(F.col("unit").alias("place"), "sid").distinct()
    brought = blobs.join(_small(places), "sid").select("place", "sid", "blob")
    linked = asked.groupBy("unit").cogroup(brought.groupBy("place")).applyInArrow(check, "a binary, b binary")
    return written(linked, "links")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _in_units(members: DataFrame, described: DataFrame) -> DataFrame:
    """``(unit, family, run, sid)``: runs put together so that those of one family meet.

    Runs with the same smallest member belong to one family, more or less. They share a unit, where a set
    comes once and is compared with its family; a unit holds about ``UNIT`` tokens. A family of more tokens
    or more than ``BLOCK`` sets is dealt to several units by run, and each run is compared by itself.
    """
    counted = members.groupBy("leader", "sid").agg(F.count("*").alias("runs"))
    sizes = counted.join(described.select("sid", "size"), "sid")
    weights = sizes.groupBy("leader").agg(
        F.sum(F.col("size") * F.col("runs")).alias("weight"),
        ((F.sum("size") > UNIT) | (F.count("*") > BLOCK)).alias("large"),
    )
    weights = written(weights, "leaders")
    units = int((weights.agg(F.sum("weight")).collect()[0][0] or 0) / UNIT) + 1
    part = F.pmod(F.xxhash64("run"), F.ceil(F.col("weight") / F.lit(UNIT)))
    unit = F.when(F.col("large"), F.xxhash64("leader", part)).otherwise(F.pmod(F.xxhash64("leader"), F.lit(units)))
    family = F.when(F.col("large"), F.col("run")).otherwise(F.col("leader"))
    return members.join(weights, "leader").select(unit.alias("unit"), family.alias("family"), "run", "sid")


def linked_sets(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``(key, size, root)`` for every non-empty text: its set's size and its component's number."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text")
    counts = shingle_counts(docs, n)
    found = written(profiles(keyed, n, percent, counts), "profiles")
    texts = docs.select("text")
    postings = found.agg(F.sum(F.length("prefix") / 8)).collect()[0][0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings / SHARD_POSTINGS) + 1)
    dealt = found.where(F.length("prefix") > 0).select("sid", "size", "prefix")
    dealt = dealt.mapInArrow(_postings(shards), "shard int, keys binary, sids binary, sizes binary")
    runs = dealt.groupBy("shard").applyInArrow(_runs(percent), "run binary, sids array<binary>")
    runs = written(runs.groupBy("run").agg(F.first("sids").alias("sids")), "runs")
    members = runs.select("run", F.array_min("sids").alias("leader"), F.explode("sids").alias("sid"))
    described = found.where(F.length("signature") > 0).select("sid", "size", "signature")
    described = described.join(members.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    described = written(described, "signatures")
    ready = _in_units(members, described).join(described, "sid")
    ready = ready.repartition("unit").sortWithinPartitions("unit", "family", "run")
    ready = ready.select("unit", "family", "run", "sid", "size", "signature")
    asked = ready.mapInArrow(_asking(percent), "unit long, family binary, sid binary")
    roots = written(components(verified(asked, texts, n, percent)), "roots")
    sids = found.groupBy("key").agg(F.first("sid").alias("sid"), F.first("size").alias("size"))
    return sids.join(roots.withColumnRenamed("u", "sid"), "sid", "left").select(
        "key", "size", F.coalesce("root", "sid").alias("root")
    )


def ngram_jaccard(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id``, the smallest ``doc_id`` reachable by links."""
    require(docs, "doc_id", "text")
    kept = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    linked = written(linked_sets(docs, n, percent), "linked")
    key = text_key(F.col("text")).alias("_key")
    ids = docs.select(key, "doc_id").groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    smallest = linked.join(ids, F.col("key") == F.col("_key")).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = linked.join(smallest, "root").select("key", "size", "component_id")
    return (
        docs.select(*kept, key)
        .join(of_key, F.col("_key") == F.col("key"), "left")
        .select(
            *kept,
            F.coalesce("size", F.lit(0).cast("long")).alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )


def _small(frame: DataFrame) -> DataFrame:
    """Broadcast behind a count; a larger side is shuffled."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the smallest ``doc_id``, nulls last.

    Documents without words stay. Of rows that agree in id and text one stays.
    """
    require(docs, "doc_id", "text")
    linked = written(linked_sets(docs, n, percent), "linked")
    named = docs.withColumn("_key", text_key(F.col("text")))
    who = named.select("doc_id", "_key").join(linked.withColumnRenamed("key", "_key"), "_key")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_key").alias("k"))
    who = who.groupBy("root", "doc_id", "_key").agg(F.count("*").alias("copies"))
    best = who.groupBy("root").agg(F.min(order).alias("best"))
    judged = who.join(best, "root").withColumn("stays", F.col("best") == order)
    judged = written(judged.select("doc_id", "_key", "copies", "stays"), "judged")
    same = lambda side: named["doc_id"].eqNullSafe(side["doc_id"]) & (named["_key"] == side["_key"])
    drop = _small(judged.where(~F.col("stays")).select("doc_id", "_key"))
    repeated = judged.where(F.col("stays") & (F.col("copies") > 1)).select("doc_id", "_key")
    kept = named.join(drop, same(drop), "left_anti")
    if repeated.limit(1).count():
        repeated = _small(repeated)
        once = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_key"])
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(once)
    return kept.select(*docs.columns)
