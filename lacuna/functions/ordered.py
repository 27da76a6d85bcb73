"""Exact order statistics that never put one whole group into one task.

A window over ``partitionBy(group).orderBy(value)`` and the built-in exact
``percentile`` both gather a group in one place. Here equal values are counted
first, the distinct values are spread over buckets by a monotone map, and only
bucket totals (a few thousand per group) are ordered together. The exact order
is then restored inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.frames import BROADCAST_ROWS, bounded, pinned

BUCKETS = 4096
FEW_PROBS = 32


def _scale(value: Column) -> Column:
    # Monotone; keeps long tails from sharing a single bucket.
    return F.signum(value) * F.log1p(F.abs(value))


def _bucketed(dist: DataFrame, keys: Sequence[str], value: str, buckets: int, max_groups: int | None) -> DataFrame:
    span = dist.groupBy(*keys).agg(
        F.min(_scale(F.col(value))).alias("_low"), F.max(_scale(F.col(value))).alias("_high")
    )
    share = (_scale(F.col(value)) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")
    joined = dist.join(bounded(span, max_groups), list(keys)) if keys else dist.crossJoin(bounded(span, 1))
    return joined.withColumn("_bucket", bucket).drop("_low", "_high")


def _bucket_offsets(tagged: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    totals = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    for s in sums:
        totals = totals.withColumn(f"_off_{s}", F.coalesce(F.sum(f"_in_{s}").over(earlier), F.lit(0)))
        totals = totals.withColumn(f"_all_{s}", F.sum(f"_in_{s}").over(whole))
    return totals


def _with_wanted(offsets: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """Attach to each bucket the fractions whose ranks fall into it (``_want``).

    Ranks and bucket starts are laid on one line per group; a rank belongs to the
    last start at or before it. The line holds buckets plus fractions, not rows.
    """
    tops = offsets.groupBy(*keys).agg((F.max("_all__n") - 1).alias("_top"))
    sides = F.explode(F.flatten(F.transform(wanted, lambda p: F.array(
        F.struct(p.alias("p"), F.floor(p * F.col("_top")).alias("at")),
        F.struct(p.alias("p"), F.ceil(p * F.col("_top")).alias("at")),
    ))))
    ranks = tops.select(*keys, sides.alias("r")).select(
        *keys, F.col("r.at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_bucket"), F.col("r.p").alias("_p")
    )
    starts = offsets.select(
        *keys, F.col("_off__n").cast("long").alias("_at"), F.lit(0).alias("_kind"), "_bucket", F.lit(None).cast("double").alias("_p")
    )
    line = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(ranks).withColumn("_bucket", F.last("_bucket", ignorenulls=True).over(line))
    want = placed.filter("_kind = 1").groupBy(*keys, "_bucket").agg(F.collect_set("_p").alias("_want"))
    return offsets.join(want, [*keys, "_bucket"])


def running_totals(
    dist: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    *,
    max_groups: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``all_<s>`` (group sum).

    ``dist`` holds one row per (keys, value), as a ``groupBy(keys, value)`` leaves it.
    """
    tagged = _bucketed(dist, keys, value, buckets, max_groups)
    offsets = _bucket_offsets(tagged, keys, sums)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(offsets, [*keys, "_bucket"])
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_off_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
        out = out.withColumnRenamed(f"_all_{s}", f"all_{s}").drop(f"_off_{s}", f"_in_{s}")
    return out.drop("_bucket")


def sites_around(
    wanted: DataFrame, sites: DataFrame, keys: Sequence[str], k: int, *, max_groups: int | None = None
) -> DataFrame:
    """For each distinct ``_v`` of ``wanted`` the k sites below it and the k at or above it:
    ``keys, _v, _site``. ``sites`` holds distinct ``keys, _v``.

    Both are placed on one line by running totals and met by place, so neither a
    product of the two nor one ordered task per group is needed.
    """
    points = (
        wanted.select(*keys, "_v", F.lit(0).alias("_is_site"), F.lit(1).alias("_is_open"))
        .unionByName(sites.select(*keys, "_v", F.lit(1).alias("_is_site"), F.lit(0).alias("_is_open")))
        .groupBy(*keys, "_v").agg(F.max("_is_site").alias("_is_site"), F.max("_is_open").alias("_is_open"))
    )
    placed = running_totals(points, keys, "_v", ["_is_site"], max_groups=max_groups)
    numbered = placed.filter("_is_site = 1").select(*keys, F.col("before__is_site").alias("_at"), F.col("_v").alias("_site"))
    place = F.col("before__is_site")
    around = placed.filter("_is_open = 1").select(*keys, "_v", F.explode(F.sequence(place - k, place + k - 1)).alias("_at"))
    return around.join(numbered, [*keys, "_at"]).drop("_at")


def grouped_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float] | Column,
    *,
    weight: str | None = None,
    max_groups: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Exact interpolated quantiles: ``keys, prob, quantile`` (linear between ranks).

    ``probs`` is a list, or an array column computed from the keys. ``weight`` names
    a count column when equal values have been counted already. Only the buckets that hold a wanted rank are ordered.
    """
    known = frame.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_n"))

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by, "_v").agg(F.sum("_n").alias("_n"))

    # A few ranks fall into a few buckets: only their rows are counted by value, the others only by bucket.
    few = None
    if not isinstance(probs, Column) and len(probs) <= FEW_PROBS and max_groups is not None and 2 * len(probs) * max_groups <= BROADCAST_ROWS:
        few = 2 * len(probs) * max_groups
    tagged = _bucketed(known if few else counted(known), keys, "_v", buckets, max_groups)
    offsets = _bucket_offsets(tagged, keys, ["_n"])

    wanted = probs if isinstance(probs, Column) else F.array(*[F.lit(float(p)) for p in probs])
    last = F.col("_all__n") - F.lit(1)

    def rank_low(p: Column, top: Column) -> Column:
        return F.floor(p * top)

    def rank_high(p: Column, top: Column) -> Column:
        return F.ceil(p * top)

    def within(rank: Column, start: Column, count: Column) -> Column:
        return (rank >= start) & (rank < start + count)

    def hits(p: Column, top: Column, start: Column, count: Column) -> Column:
        return within(rank_low(p, top), start, count) | within(rank_high(p, top), start, count)

    if isinstance(probs, Column) or len(probs) > FEW_PROBS:
        offsets = _with_wanted(offsets, keys, wanted)
    else:
        offsets = offsets.withColumn(
            "_want", F.filter(wanted, lambda p: hits(p, last, F.col("_off__n"), F.col("_in__n")))
        ).filter(F.size("_want") > 0)

    if few:
        offsets = bounded(offsets, few)
        tagged = counted(tagged.join(bounded(offsets.select(*keys, "_bucket"), few), [*keys, "_bucket"], "left_semi"), "_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged.join(offsets, [*keys, "_bucket"]).withColumn(
        "_before", F.col("_off__n") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    found = placed.withColumn(
        "prob", F.explode(F.filter("_want", lambda p: hits(p, last, F.col("_before"), F.col("_n"))))
    )
    position = F.col("prob") * F.col("_top")
    return (
        found.withColumn("_top", last)
        .groupBy(*keys, "prob", "_top")
        .agg(
            F.max(F.when(within(rank_low(F.col("prob"), last), F.col("_before"), F.col("_n")), F.col("_v"))).alias("_lo"),
            F.max(F.when(within(rank_high(F.col("prob"), last), F.col("_before"), F.col("_n")), F.col("_v"))).alias("_hi"),
        )
        .withColumn("quantile", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (position - F.floor(position)))
        .select(*keys, "prob", "quantile")
    )


def cut_points(
    frame: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    wanted: DataFrame,
    *,
    share: Column | None = None,
    pin_rows: int,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The row at a given place of a group's order: ``keys, tag, cut, cut_tie``.

    ``wanted`` holds ``keys, tag, place`` (1-based). ``share`` maps the order value
    monotonically into [0, 1]; by default the value itself lies there. A first pass
    counts rows per bucket, a second orders only the buckets where a place falls.
    Comparing rows with the cut selects exactly the first ``place`` rows.
    """
    spread = F.col(order) if share is None else share
    bucket = F.least(F.floor(spread * buckets), F.lit(buckets - 1)).cast("int")
    tagged = frame.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    ends = (
        placed.join(bounded(wanted.filter("place > 0"), pin_rows), list(keys))
        .filter("_before < place and place <= _before + _in")
        .select(*keys, "tag", "_bucket", (F.col("place") - F.col("_before")).alias("_rank"))
    )
    ends = pinned(ends, pin_rows)
    inside = Window.partitionBy(*keys, "tag").orderBy(order, tie)
    found = (
        tagged.join(bounded(ends, pin_rows), [*keys, "_bucket"])
        .withColumn("_n", F.row_number().over(inside))
        .filter("_n = _rank")
    )
    return pinned(found.select(*keys, "tag", F.col(order).alias("cut"), F.col(tie).alias("cut_tie")), pin_rows)


def within(order: Column, tie: Column, cut: Column, cut_tie: Column) -> Column:
    """Whether a row lies at or before the cut; false where there is no cut."""
    same = (order == cut) & (tie <= cut_tie)
    return F.coalesce((order < cut) | same, F.lit(False))


def up_to(order: str, tie: str, cut: str = "cut", cut_tie: str = "cut_tie") -> Column:
    """:func:`within` by the names of columns."""
    return within(F.col(order), F.col(tie), F.col(cut), F.col(cut_tie))
