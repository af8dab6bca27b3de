"""Mixing sources to target weights by min-cost flow over overlapping sources.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their
sources), so the flow network has one node per pattern and one per source, however many documents
there are. Words flow from patterns to source quotas; the first copy of a pattern costs nothing, each
further copy more than the one before (convex), so repetition is used only where a quota cannot be
met without it. The flow is then realised by documents in a seeded order.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; documents with an empty array of sources count for none; repeated rows are
separate documents of equal rank and share one fate; an empty table gives an empty mix. Columns of
the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.shared import WORD, require, written

SHARE = 1.5  # of all words, what the mix holds
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
BINS = 4096  # of the seeded order; the bin a quota ends in is ordered exactly


def text_size(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size.

    What a full source cannot take is shared among the others by weight until none is above.
    """
    given = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0]
    left = min(float(total), most * sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in open_:
                given[i] = left * weights[i] / weight
            break
        for i in full:
            given[i] = most * float(sizes[i])
        left -= sum(given[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def route(
    patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], most_copies: int
) -> dict[tuple[int, int], int]:
    """Words from each pattern to each source at least cost; ``{(pattern, source): words}``.

    Successive shortest paths with potentials. Copy ``c`` of a pattern is an arc of the pattern's
    size and cost ``c``; every augmentation fills an arc, so their number follows the few arcs.
    """
    n_p, n_s = len(patterns), len(quotas)
    source, sink = 0, 1 + n_p + n_s
    graph: list[list[list]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, size) in enumerate(patterns):
        for copy in range(most_copies):
            arc(source, 1 + p, size, copy)
        for s in sorted(members):
            arc(1 + p, 1 + n_p + s, size * most_copies, 0)
    for s, quota in enumerate(quotas):
        arc(1 + n_p + s, sink, quota, 0)

    height = [0] * (sink + 1)
    while True:
        reach, via = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            far, a = heapq.heappop(heap)
            if far > reach[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                step = far + cost + height[a] - height[b]
                if room > 0 and step < reach.get(b, float("inf")):
                    reach[b], via[b] = step, (a, k)
                    heapq.heappush(heap, (step, b))
        if sink not in reach:
            break
        farthest = max(reach.values())
        height = [h + reach.get(v, farthest) for v, h in enumerate(height)]
        path, at = [], sink
        while at != source:
            a, k = via[at]
            path.append((a, k))
            at = a
        flow = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= flow
            b, _, _, back = graph[a][k]
            graph[b][back][1] += flow
    return {
        (p, b - 1 - n_p): graph[b][back][1]
        for p in range(n_p)
        for b, _, cost, back in graph[1 + p]
        if b > n_p and graph[b][back][1] > 0
    }


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` has ``doc_id``, ``text`` and ``source`` (a string, or an array of strings for documents
    of several sources; then ``source_size`` and ``target`` are sums over the document's sources).
    Sources in code point order, null last, weigh ``weights`` in turn.
    """
    require(docs, "doc_id", "text", "source")
    own = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in own]
    many = docs.schema["source"].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.coalesce("source", F.array().cast("array<string>")))) if many else F.array("source")
    own_key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    place = F.conv(F.substring(F.md5(own_key), 1, 15), 16, 10).cast("long")
    sized = docs.select(
        *kept, members.alias("_members"), text_size(F.col("text")).alias("size"), place.alias("_place")
    )
    # The narrow columns are kept once; texts are counted in one pass.
    small = written(sized.select("_members", "size", "_place"), "sizes")

    bin_ = F.pmod("_place", F.lit(BINS)).cast("int")
    grouped = small.groupBy("_members").agg(F.sum("size").alias("size")).collect()
    names = sorted({m for row in grouped for m in row["_members"]}, key=lambda m: (m is None, m or ""))
    index = {name: i for i, name in enumerate(names)}
    patterns = [(frozenset(index[m] for m in row["_members"]), row["size"] or 0) for row in grouped]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    sizes = [sum(size for members_, size in patterns if i in members_) for i in range(len(names))]
    total = share * sum(size for _, size in patterns)
    wanted = targets(sizes, weight, total, most_copies)
    flow = route(patterns, [math.floor(t + 1e-6) for t in wanted], most_copies)
    takes = [sum(flow.get((p, s), 0) for s in range(len(names))) for p in range(len(patterns))]

    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [
            (
                row["_members"],
                float(sum(sizes[i] for i in members_)) if members_ else 0.0,
                float(sum(wanted[i] for i in members_)) if members_ else 0.0,
                take // size if size else 0,
                take % size if size else 0,
            )
            for row, (members_, size), take in zip(grouped, patterns, takes, strict=True)
        ],
        "_members array<string>, _source_size double, _target double, _copies long, _rest long",
    )
    plan = F.broadcast(plan)  # one row per membership pattern

    # Every document is taken ``_copies`` times; ``_rest`` more words come from the seeded order.
    # Bins that lie below the rest are taken whole; inside the bin where it ends, documents follow
    # the order until it is used up.
    bins = small.groupBy("_members", bin_.alias("_bin")).agg(F.sum("size").alias("words"))
    by_bin = Window.partitionBy("_members").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(by_bin), F.lit(0).cast("long"))
    bins = bins.withColumn("before", before).join(plan.select("_members", "_rest"), "_members")
    last = bins.where((F.col("before") <= F.col("_rest")) & (F.col("_rest") < F.col("before") + F.col("words")))
    last = last.select("_members", "_bin", "before", "_rest")
    inside = small.withColumn("_bin", bin_).join(F.broadcast(last), ["_members", "_bin"])
    by_place = inside.groupBy("_members", "_bin", "_place").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("_rest").alias("_rest")
    )
    in_order = Window.partitionBy("_members", "_bin").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("words").over(in_order), F.lit(0).cast("long"))
    # A document is in if more than half of it fits.
    ends = (
        by_place.withColumn("ahead", ahead)
        .where(F.col("ahead") + F.col("words") / 2 < F.col("_rest"))
        .groupBy("_members", "_bin")
        .agg(F.max("_place").alias("_to"))
    )
    cut = last.select("_members", F.col("_bin").alias("_last")).join(
        ends.select("_members", "_to"), "_members", "left"
    )
    cut = F.broadcast(plan.join(cut, "_members", "left"))  # still one row per pattern

    chosen = (bin_ < F.col("_last")) | ((bin_ == F.col("_last")) & (F.col("_place") <= F.col("_to")))
    copies = F.col("_copies") + F.coalesce(chosen, F.lit(False)).cast("long")
    return (
        sized.join(cut, sized["_members"] == cut["_members"], "left")
        .select(
            *kept,
            "size",
            F.coalesce("_source_size", F.lit(0.0)).cast("long").alias("source_size"),
            F.coalesce("_target", F.lit(0.0)).alias("target"),
            F.coalesce(copies, F.lit(0).cast("long")).alias("copies"),
            F.coalesce(copies * F.col("size"), F.lit(0).cast("long")).alias("taken"),
        )
    )
