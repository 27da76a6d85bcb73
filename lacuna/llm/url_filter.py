"""URL filters by a temporal list join.

List entries come as dated events: a pattern is added to or removed from a list. They
become validity intervals, from each addition to the next removal of the pattern in that
list. An as-of join evaluates every capture against the entries that were active when it
was fetched.

A capture's URL stands for a bounded set of patterns: its host, the host's parent
domains, and the host with leading parts of its path. Pattern and period are joined by
equality: intervals and fetch times are dealt to periods of ``PERIOD`` days, so a pattern
with a long history meets a capture only with the few intervals of one period. Equal
captures are judged once. A popular host is a skewed key of an inner join, which is split
at run time; a list of bounded size is broadcast instead.

Defined cases: a null or unreadable URL has no patterns; a null fetch time lies in no
interval; events with a null in list, kind, pattern, action or time are left out, repeated
events count once; of an addition and a removal at the same time the removal is the
later one. Removing what was not added changes nothing. An entry is active from its
time on, and no more at the time of its removal. Repeated captures are judged alike.
Extra columns are not read. Without events nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.storage import written

#: Days of a period.
PERIOD = 32
#: Interval rows that may be broadcast.
BROADCAST_ROWS = 500_000
DAY = 86_400


def host_of(url: Column) -> Column:
    """Lower-cased host, without user and port; empty if the URL has none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def path_parts(url: Column) -> Column:
    """Non-empty parts of the path."""
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def patterns(host: Column, labels: Column, parts: Column, most_parts: int) -> Column:
    """Every ``kind, pattern`` a URL stands for: ``host``, ``domain`` (with its parents), ``prefix`` (up to ``most_parts`` parts).

    ``labels`` and ``parts`` are the parts of host and path.
    """
    of = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: of("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    depth = F.least(F.size(parts), F.lit(most_parts))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda n: of("prefix", F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    return F.when(host != "", F.concat(F.array(of("host", host)), domains, prefixes))


def canonical(kind: Column, pattern: Column) -> Column:
    """A pattern as ``patterns`` writes it; a prefix of a whole host ends with a slash."""
    cut = F.instr(pattern, "/")
    host = F.lower(F.when(cut > 0, F.substring(pattern, F.lit(1), cut - 1)).otherwise(pattern))
    parts = F.filter(F.split(F.when(cut > 0, F.substring(pattern, cut, F.length(pattern))).otherwise(""), "/"), lambda p: p != "")
    return F.when(kind == "prefix", F.concat_ws("/", host, F.array_join(parts, "/"))).otherwise(F.lower(pattern))


def intervals(events: DataFrame) -> DataFrame:
    """``list, verdict, kind, pattern, since, until``: disjoint times in which an entry is active; ``until`` may be null.

    ``events``: ``list, verdict, kind, pattern, action, at``. An entry's events are few,
    one for each change of it, and equal ones are put together before they are ordered.
    """
    key = ["list", "verdict", "kind", "pattern"]
    known = events.select("list", "verdict", "kind", canonical(F.col("kind"), F.col("pattern")).alias("pattern"), F.col("at").cast("timestamp").alias("at"), "action").dropna()
    known = known.groupBy(*key, "at").agg(F.min((F.col("action") == "add").cast("int")).alias("active"))
    order = Window.partitionBy(*key).orderBy("at")
    changes = known.withColumn("before", F.coalesce(F.lag("active").over(order), F.lit(0))).filter("active <> before")
    return changes.withColumn("until", F.lead("at").over(order)).filter("active = 1").select(*key, F.col("at").alias("since"), "until")


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``url, fetched, blocked, n_entries, lists`` for every distinct capture that meets an active entry.

    ``blocked``: some such entry says ``block`` and none says ``allow``; ``lists``: the
    names of their lists, in order, separated by commas.
    """
    period = lambda at: F.floor(F.unix_timestamp(at) / (PERIOD * DAY)).cast("int")
    known = captures.select("url", F.col("fetched").cast("timestamp").alias("fetched")).filter("url is not null and fetched is not null").distinct()
    spans = intervals(events)
    last = known.agg(F.max(period(F.col("fetched"))).alias("last")).first()["last"]
    most_parts = spans.filter("kind = 'prefix'").agg(F.max(F.size(F.filter(F.split("pattern", "/"), lambda p: p != "")))).first()[0]
    high = F.when(F.col("until").isNull(), F.lit(last)).otherwise(F.least(F.lit(last), period(F.col("until"))))
    low = period(F.col("since"))
    dealt = spans.filter(low <= high).withColumn("period", F.explode(F.sequence(low, high)))
    dealt = written(dealt, "intervals")
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    parsed = known.select("url", "fetched", period(F.col("fetched")).alias("period"), host_of(F.col("url")).alias("host"), path_parts(F.col("url")).alias("parts"))
    parsed = parsed.withColumn("labels", F.split("host", r"\."))
    keys = parsed.select("url", "fetched", "period", F.inline(patterns(F.col("host"), F.col("labels"), F.col("parts"), max(0, (most_parts or 1) - 1))))
    met = keys.join(dealt, ["kind", "pattern", "period"]).filter("since <= fetched and (until is null or fetched < until)")
    found = met.groupBy("url", "fetched").agg(
        F.count(F.lit(1)).alias("n_entries"), F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return found.select("url", "fetched", (F.col("block") & ~F.col("allow")).alias("blocked"), "n_entries", "lists")


def url_filter(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``capture_id, blocked, n_entries, lists`` for every row of ``captures`` (``capture_id, url, fetched``)."""
    rows = captures.select("capture_id", F.col("url").alias("of"), F.col("fetched").cast("timestamp").alias("at"))
    found = judge(captures, events)
    out = rows.join(found, (rows["of"] == found["url"]) & (rows["at"] == found["fetched"]), "left")
    return out.select("capture_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"))
