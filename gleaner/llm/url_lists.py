"""URL filters: captures judged by the list entries in force when they were fetched.

A list is a log of dated entries: on a day, a list adds or removes a pattern (a domain with all its
subdomains, or a host with a path prefix). The log becomes validity intervals, and every capture is
joined as of its day with the intervals of the patterns it falls under.

Captures are first reduced to sites (host, leading path, day), so one host with a third of all
captures is one row a day in the as-of join; the last join, back to the captures, has the captures as
its streamed side, where adaptive execution splits a hot host.

Defined results: a null or unparsable URL, or a null day, falls under no pattern and is allowed.
Entries with a null list, pattern or day are ignored. Of several entries of one list and pattern on
one day the last by ``seq`` counts, then "remove" before "add" is settled in favour of "add". An
entry holds from its own day on. Repeated captures are judged alike; empty tables give empty results
or allow everything. Columns of ``captures`` named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.shared import let, require, written

RESULT = ("host", "blocked", "n_lists", "lists", "since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)``: days on which a pattern is listed, end excluded.

    One state per list, pattern and day is kept before the window, so a pattern's window holds at
    most one row a day however often it was logged.
    """
    require(entries, "list", "pattern", "day", "action", "seq")
    known = entries.where(
        F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull()
    )
    rank = F.struct(F.col("seq"), F.when(F.col("action") == "add", 1).otherwise(0))
    daily = known.groupBy("list", "pattern", "day").agg(F.max_by(F.col("action"), rank).alias("action"))
    following = Window.partitionBy("list", "pattern").orderBy("day")
    return (
        daily.withColumn("valid_to", F.lead("day").over(following))
        .where(F.col("action") == "add")
        .select(
            "list",
            "pattern",
            F.col("day").alias("valid_from"),
            F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("valid_to"),
        )
    )


def _patterns(host: Column, path: Column) -> Column:
    """Every pattern a site falls under: the host's domains, and the host with each leading path."""
    domains = let(
        F.split(host, r"\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
        ),
    )
    paths = let(
        segments_of(path),
        lambda segments: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(segments)), lambda i: i > 0),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")),
        ),
    )
    return F.concat(domains, paths)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with ``url`` and ``fetched_on``) with ``host``, ``blocked``, ``n_lists``, ``lists`` and ``since``.

    ``lists`` are the distinct lists with an entry in force, sorted and comma-joined; ``since`` is
    the earliest day from which one of these entries holds.
    """
    require(captures, "url", "fetched_on")
    spans = written(intervals(entries), "intervals")
    # Only as many leading segments as the longest listed path are compared.
    depth = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).collect()[0][0] or 0
    kept = [c for c in captures.columns if c not in RESULT]
    lead = F.array_join(F.slice(segments_of(path_of(F.col("url"))), 1, max(depth, 1)), "/")
    lead = F.concat(F.lit("/"), lead) if depth else F.lit("")
    keyed = captures.select(*kept, host_of(F.col("url")).alias("host"), lead.alias("_lead"))

    sites = keyed.where(F.col("host").isNotNull()).select("host", "_lead", "fetched_on").distinct()
    under = sites.select("*", F.explode(_patterns(F.col("host"), F.col("_lead"))).alias("pattern"))
    in_force = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("fetched_on") < F.col("valid_to"))
    found = (
        under.join(spans, "pattern")
        .where(in_force)
        .groupBy("host", "_lead", "fetched_on")
        .agg(F.array_sort(F.collect_set("list")).alias("_lists"), F.min("valid_from").alias("since"))
    )
    return (
        keyed.join(found, ["host", "_lead", "fetched_on"], "left")
        .select(
            *kept,
            "host",
            F.col("_lists").isNotNull().alias("blocked"),
            F.coalesce(F.size("_lists"), F.lit(0)).cast("long").alias("n_lists"),
            F.coalesce(F.array_join("_lists", ","), F.lit("")).alias("lists"),
            "since",
        )
    )
