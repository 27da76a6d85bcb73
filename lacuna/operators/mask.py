"""Reproducible, nested, type-aware hiding of known cells.

Each eligible cell gets an exponential clock ``-ln(u)/w`` from a hashed uniform
``u`` and its weight ``w``; the cells whose clocks ring first are hidden. Any
prefix of that order is a weighted sample without replacement, so the
intensities nest. A prefix is fixed by its last member, hence masking a table is
one comparison per cell against a small table of cut-offs. The cut-offs come
from a histogram of the clocks and an exact look inside the one bucket where a
budget ends: no column is ever ordered as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import clip, hash_normal_value, hash_uniform
from lacuna.functions.frames import bounded, handed_over, local_frame, pinned, to_cells, union_all
from lacuna.functions.ordered import cut_points, grouped_quantiles, running_totals, within
from lacuna.operators.profile import column_profile, missing_share
from lacuna.plans.schema import CATEGORICAL, HELD_OUT, OBSERVED, REGISTRY_MISSING, MaskSettings, Study

GROUP = ["cohort", "feature"]


def unit_seed(base: int, cohort: str, design: str) -> int:
    """First 32 bits of sha256; the intensities of a unit share it."""
    return int(hashlib.sha256(f"{base}|{cohort}|{design}".encode()).hexdigest()[:8], 16)


def unit_seed_column(base, cohort: Column, design: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(base)), cohort, design)
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def budgets(profile: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``cohort, feature, alpha, budget`` with budget = floor(n * alpha * missing share).

    Complete columns, zero budgets and columns with fewer observed cells than the
    largest budget drop out.
    """
    grid = F.explode(F.array(*[F.lit(float(a)) for a in sorted(alphas)]))
    sized = missing_share(profile).filter("missing > 0 and n_observed > 0").withColumn("alpha", grid)
    sized = sized.withColumn("budget", F.floor(F.col("n") * F.col("alpha") * F.col("missing")).cast("long"))
    largest = F.max("budget").over(Window.partitionBy(*GROUP))
    return (
        sized.withColumn("_top", largest)
        .filter((F.col("_top") > 0) & (F.col("n_observed") >= F.col("_top")))
        .select("cohort", "feature", "alpha", "budget")
    )


# -- weights ----------------------------------------------------------------


def mar_drivers(profile: DataFrame, settings: MaskSettings, columns: Sequence[str]) -> dict[str, list[str]]:
    """For each cohort the columns observed in at least the wanted share of it, most complete first."""
    order = Window.partitionBy("cohort").orderBy(F.desc("observed"), "feature")
    shares = (
        profile.filter(F.col("feature").isin(list(columns)))
        .select("cohort", "feature", (F.col("n_observed") / F.col("n")).alias("observed"))
        .filter(F.col("observed") >= settings.driver_min_observed)
        .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= settings.max_drivers)
    )
    found: dict[str, list[str]] = {}
    for row in shares.orderBy("cohort", "feature").collect():  # cohorts x max_drivers rows at most
        found.setdefault(row["cohort"], []).append(row["feature"])
    return found


def mar_betas(settings: MaskSettings, cohort: str, target: str, drivers: Sequence[str]) -> dict[str, float]:
    """Coefficients ~ N(0, 1/sqrt(k)) of one target, drawn for each cohort; a column never drives itself."""
    own, seed = [d for d in drivers if d != target], unit_seed(settings.seed, cohort, "mar")
    return {d: hash_normal_value(seed, "beta", target, d) / math.sqrt(len(own)) for d in own}


def driver_scores(frame: DataFrame, drivers: Sequence[str], rows: int | None = None) -> DataFrame:
    """Wide z-scores ``z_<driver>`` per cohort, missing entries at the mean."""
    stats = frame.groupBy("cohort").agg(*[
        x for d in drivers for x in (
            F.avg(d).alias(f"_m_{d}"), F.count(d).alias(f"_c_{d}"), F.count(F.lit(1)).alias(f"_n_{d}"),
            F.stddev_pop(d).alias(f"_s_{d}"),
        )
    ])
    if rows is not None:
        # Sums of doubles come out a little different in every job; the passes over clocks need the same ones.
        stats = pinned(stats, rows)
    joined = frame.join(bounded(stats, rows), "cohort")
    out = []
    for d in drivers:
        # Filling with the mean shrinks the spread by the observed share.
        spread = F.col(f"_s_{d}") * F.sqrt(F.col(f"_c_{d}") / F.col(f"_n_{d}"))
        spread = F.when(F.coalesce(spread, F.lit(0.0)) == 0, 1.0).otherwise(spread)
        value = F.coalesce(F.col(d), F.col(f"_m_{d}"))
        out.append(((value - F.col(f"_m_{d}")) / spread).alias(f"z_{d}"))
    return joined.select(*frame.columns, *out)


def mar_weight(settings: MaskSettings, target: str, drivers: Mapping[str, Sequence[str]]) -> Column:
    """sigmoid(clip(scale * z.beta)) of the row's cohort, as a column over :func:`driver_scores`; 1 without drivers."""
    out = F.lit(1.0)
    for cohort, names in drivers.items():
        betas = mar_betas(settings, cohort, target, names)
        if betas:
            logit = sum((F.col(f"z_{d}") * F.lit(b) for d, b in betas.items()), F.lit(0.0))
            logit = clip(logit * settings.logit_scale, -settings.logit_clip, settings.logit_clip)
            out = F.when(F.col("cohort") == cohort, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).otherwise(out)
    return out


def level_counts(cells: DataFrame) -> DataFrame:
    return cells.filter("value is not null").groupBy("cohort", "feature", "kind", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def tail_profile(levels: DataFrame, study: Study) -> DataFrame:
    """``cohort, feature, low, high, n_levels, branch``: which MNAR rule a column takes.

    ``tails`` for numeric columns with enough distinct values, ``rare`` for
    categorical or few-valued ones, ``rare_wide`` where the tails degenerate.
    """
    s = study.masks
    per_column = levels.groupBy("cohort", "feature", "kind").agg(F.count(F.lit(1)).alias("n_levels"))
    spread = levels.filter(~F.col("kind").isin(list(CATEGORICAL)))
    cut = grouped_quantiles(
        spread, GROUP, "value", [s.tail_quantile, 1.0 - s.tail_quantile], weight="n", max_groups=study.groups(),
    )
    ends = cut.groupBy(*GROUP).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    in_tail = (F.col("value") <= F.col("low")) | (F.col("value") >= F.col("high"))
    share = (
        spread.join(bounded(ends, study.groups()), GROUP)
        .groupBy(*GROUP, "low", "high")
        .agg((F.sum(F.when(in_tail, F.col("n")).otherwise(0)) / F.sum("n")).alias("tail_share"))
    )
    few = F.col("kind").isin(list(CATEGORICAL)) | (F.col("n_levels") < s.min_distinct)
    collapsed = (F.col("tail_share") > 1.0 - s.degenerate_tail) | (F.col("tail_share") < s.degenerate_tail)
    return per_column.join(share, GROUP, "left").select(
        "cohort", "feature", "low", "high", "n_levels",
        F.when(few, "rare").when(collapsed, "rare_wide").otherwise("tails").alias("branch"),
    )


def rare_levels(levels: DataFrame, max_groups: int | None = None) -> DataFrame:
    """``cohort, feature, value`` for the least frequent half of the levels (at least one).

    Order is (count, value). Levels are ranked by how many levels share a count;
    only the count where the half ends is looked into, again in buckets.
    """
    by_count = levels.groupBy(*GROUP, "n").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*GROUP)
    before = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_count.select(
        *GROUP, "n", "_m",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(whole).alias("_k"),
    ).withColumn("_half", F.greatest(F.lit(1), F.floor(F.col("_k") / 2)))
    placed = placed.filter("_k >= 2 and _before < _half")
    tagged = levels.select(*GROUP, "n", "value").join(placed, [*GROUP, "n"])
    inside = tagged.filter("_before + _m <= _half").select(*GROUP, "value")
    tied = running_totals(
        tagged.filter("_before + _m > _half").withColumn("_one", F.lit(1)), GROUP, "value", ["_one"],
        max_groups=max_groups,
    )
    return inside.unionByName(tied.filter("_before + before__one < _half").select(*GROUP, "value"))


# -- clocks and cut-offs ----------------------------------------------------


def clock(seed: Column, feature: Column, record: Column, weight: Column) -> Column:
    safe = F.when(weight > 0, weight).otherwise(F.lit(1e-12))
    return -F.log(hash_uniform(seed, feature, record)) / safe


def _mnar_weights(frame: DataFrame, study: Study, features: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``frame`` with the lookups it needs, and the weight of each feature's cell: its own value decides, by declared kind."""
    s, groups = study.masks, study.groups()
    cells = to_cells(frame, study.keys, {c: study.codebook.kinds[c] for c in features})
    # Counted once; quantiles, shares and rare levels read the counts.
    levels = handed_over(level_counts(cells), "levels")
    rules = pinned(tail_profile(levels, study), groups)
    found = {(r["cohort"], r["feature"]): r for r in rules.collect()}

    def levels_of(which: str) -> DataFrame:
        wanted = rules.filter(F.col("branch") == which).select(*GROUP)
        return levels.join(bounded(wanted, groups), GROUP, "left_semi")

    # Rows of the few-valued columns: declared levels or fewer than min_distinct.
    few = sum(max(len(v.levels), s.min_distinct) for v in study.codebook.variables) * len(study.cohorts)
    rare: dict[tuple, list[float]] = {}
    for r in pinned(rare_levels(levels_of("rare"), groups), few).collect():
        rare.setdefault((r["cohort"], r["feature"]), []).append(r["value"])

    cohorts = sorted({c for c, _ in found})
    rows, fields = [[c] for c in cohorts], ["cohort string"]
    for k, f in enumerate(features):
        fields += [f"_low_{k} double", f"_high_{k} double", f"_rare_{k} array<double>"]
        for row in rows:
            rule = found.get((row[0], f))
            tails = rule is not None and rule["branch"] == "tails"
            row += [rule["low"] if tails else None, rule["high"] if tails else None, rare.get((row[0], f))]
    frame = frame.join(bounded(local_frame(frame.sparkSession, rows, ", ".join(fields)), len(study.cohorts)), "cohort", "left")

    wide = sorted({f for (_, f), r in found.items() if r["branch"] == "rare_wide"})
    lookup = rare_levels(levels_of("rare_wide"), groups) if wide else None
    weights = {}
    for k, f in enumerate(features):
        value = F.col(f).cast("double")
        lifted = F.array_contains(f"_rare_{k}", value)
        if f in wide:  # many levels: an ordinary join on the value
            own = lookup.filter(F.col("feature") == f).select("cohort", F.col("value").alias(f"_value_{k}"), F.lit(True).alias(f"_wide_{k}"))
            frame = frame.withColumn(f"_value_{k}", value).join(own, ["cohort", f"_value_{k}"], "left").drop(f"_value_{k}")
            lifted = F.coalesce(f"_wide_{k}", lifted)
        in_tail = (value <= F.col(f"_low_{k}")) | (value >= F.col(f"_high_{k}"))
        weights[f] = F.when(in_tail, s.tail_weight).when(lifted, s.rare_weight).otherwise(1.0)
    return frame, weights


def cell_weights(
    frame: DataFrame, study: Study, features: Sequence[str], drivers: Mapping[str, Sequence[str]] | None = None
) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """``frame`` with the lookups it needs, and the weight of a record's cell as a column for each ``(design, feature)``."""
    weights: dict[tuple[str, str], Column] = {}
    for design in study.masks.designs:
        if design == "mcar":
            own = {c: F.lit(1.0) for c in features}
        elif design == "mnar":
            frame, own = _mnar_weights(frame, study, features)
        elif design == "mar":
            drivers = drivers or {}
            named = sorted({d for names in drivers.values() for d in names})
            frame = driver_scores(frame, named, len(study.cohorts)) if named else frame
            own = {c: mar_weight(study.masks, c, drivers) for c in features}
        else:
            raise ValueError(f"unknown design {design!r}")
        weights |= {(design, c): w for c, w in own.items()}
    return frame, weights


def weighted_cells(frame: DataFrame, study: Study, features: Sequence[str], drivers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every cell once per design with its weight: ``keys, feature, kind, value, weight, design``."""
    kinds = study.codebook.kinds
    frame, weights = cell_weights(frame, study, features, drivers)
    parts = []
    for design in study.masks.designs:
        args = [x for c in features for x in (F.lit(c), F.lit(kinds[c]), F.col(c).cast("double"), weights[design, c])]
        cells = frame.select(*study.keys, F.stack(F.lit(len(features)), *args).alias("feature", "kind", "value", "weight"))
        parts.append(cells.withColumn("design", F.lit(design)))
    return union_all(parts)


def with_clocks(frame: DataFrame, study: Study, eligible: Collection[str], drivers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``keys, <feature>..., clocks``: a clock for each design and column by their places, NULL for missing cells and
    columns without a budget. One expression goes over all of them, which keeps the generated code small."""
    features = [c for c in study.codebook.names if c in frame.columns]
    weighted, weights = cell_weights(frame, study, features, drivers)
    seeds = [(c, *(unit_seed(study.masks.seed, c, d) for d in study.masks.designs)) for c in study.cohorts]
    units = local_frame(frame.sparkSession, seeds, ", ".join(["cohort string", *(f"_seed_{i} long" for i in range(len(study.masks.designs)))]))
    joined = weighted.join(bounded(units, len(seeds)), "cohort")

    def of(design: str, seed: Column) -> Column:
        cells = F.array(*[
            F.struct(F.lit(c).alias("feature"), (F.col(c).isNotNull() & F.lit(c in eligible)).alias("open"), weights[design, c].cast("double").alias("weight"))
            for c in features
        ])
        return F.transform(cells, lambda x: F.when(x["open"], clock(seed, x["feature"], F.col(study.id_column), x["weight"])))

    clocks = F.array(*[of(d, F.col(f"_seed_{i}")) for i, d in enumerate(study.masks.designs)])
    return joined.select(*study.keys, *[F.col(c).cast("double").alias(c) for c in features], clocks.alias("clocks"))


def cutoffs(clocks: DataFrame, budget: DataFrame, study: Study) -> DataFrame:
    """``cohort, feature, design, alpha, cut, cut_tie``: last cell each budget takes."""
    rows = study.groups(designs=True, alphas=True)
    designs = local_frame(clocks.sparkSession, [(d,) for d in study.masks.designs], "design string")
    wanted = budget.crossJoin(F.broadcast(designs)).select(
        *GROUP, "design", F.col("alpha").alias("tag"), F.col("budget").alias("place")
    )
    # 1 - exp(-clock) rises with the clock and lies in (0, 1).
    share = F.lit(1.0) - F.exp(-F.col("clock"))
    cut = cut_points(clocks, [*GROUP, "design"], "clock", study.id_column, wanted, share=share, pin_rows=rows)
    return cut.withColumnRenamed("tag", "alpha")


# -- the masks --------------------------------------------------------------


def hidden(frame: DataFrame, study: Study) -> DataFrame:
    """The wide matrix with ``hidden``: for each design and column, by their places, how many of the intensities, from
    the lowest, leave the cell as it is. All above them hide it, as intensities nest.

    ``frame`` is the wide encoded matrix with a ``cohort`` column. The clocks are made once and handed over
    in files, as rows of records; the cells only stream into counts. What returns is a lookup by cohort.
    """
    designs, alphas = study.masks.designs, sorted(study.masks.alphas)
    features = [c for c in study.codebook.names if c in frame.columns]
    profile = pinned(column_profile(frame, features), study.groups())
    budget = pinned(budgets(profile, study.masks.alphas), study.groups(alphas=True))
    eligible = {r["feature"] for r in budget.collect()}
    drivers = mar_drivers(profile, study.masks, features) if "mar" in designs else {}

    clocks = handed_over(with_clocks(frame, study, eligible, drivers), "clocks")
    places = [(i, k) for i in range(len(designs)) for k, c in enumerate(features) if c in eligible]
    found: dict[tuple, dict] = {}
    if places:
        args = [x for i, k in places for x in (F.lit(features[k]), F.lit(designs[i]), F.col("clocks")[i][k])]
        rung = clocks.select(*study.keys, F.stack(F.lit(len(places)), *args).alias("feature", "design", "clock"))
        cut = cutoffs(rung.filter("clock is not null"), budget, study)
        found = {(r["cohort"], r["design"], r["feature"], r["alpha"]): r for r in cut.collect()}

    def ends(cohort: str, design: str, feature: str) -> list[dict]:
        cuts = [found.get((cohort, design, feature, float(a))) for a in alphas]
        return [{"cut": c and c["cut"], "cut_tie": c and c["cut_tie"]} for c in cuts]

    tie = clocks.schema[study.id_column].dataType.simpleString()
    lookup = local_frame(
        frame.sparkSession, [(c, [[ends(c, d, f) for f in features] for d in designs]) for c in study.cohorts],
        f"cohort string, _ends array<array<array<struct<cut: double, cut_tie: {tie}>>>>",
    )

    def left(row: Column, design: Column) -> Column:
        def of(ring: Column, place: Column) -> Column:
            beyond = F.filter(F.col("_ends")[design][place], lambda e: ~within(ring, F.col(study.id_column), e["cut"], e["cut_tie"]))
            return F.size(beyond).cast("tinyint")
        return F.transform(row, of)

    joined = clocks.join(bounded(lookup, len(study.cohorts)), "cohort")
    return joined.select(*study.keys, *features, F.transform("clocks", left).alias("hidden"))


def masked_cells(matrix: DataFrame, study: Study) -> DataFrame:
    """The cells of every (design, alpha) of what :func:`hidden` returns: ``keys, feature, kind, design, alpha,
    truth, status, masked``. A view: rows of records become cells while they stream into what reads them."""
    features = [c for c in study.codebook.names if c in matrix.columns]
    args = [x for k, c in enumerate(features) for x in (F.lit(c), F.lit(study.codebook.kinds[c]), F.lit(k), F.col(c))]
    cells = matrix.select(*study.keys, "hidden", F.stack(F.lit(len(features)), *args).alias("feature", "kind", "_place", "truth"))
    units = local_frame(
        matrix.sparkSession,
        [(d, float(a), i, k) for i, d in enumerate(study.masks.designs) for k, a in enumerate(sorted(study.masks.alphas))],
        "design string, alpha double, _design int, _alpha int",
    )
    status = (
        F.when(F.col("truth").isNull(), REGISTRY_MISSING)
        .when(F.col("hidden")[F.col("_design")][F.col("_place")] <= F.col("_alpha"), HELD_OUT)
        .otherwise(OBSERVED)
    )
    return cells.crossJoin(F.broadcast(units)).withColumn("status", status.cast("tinyint")).select(
        *study.keys, "feature", "kind", "design", "alpha", "truth", "status",
        F.when(F.col("status") == OBSERVED, F.col("truth")).alias("masked"),
    )


def inject(frame: DataFrame, study: Study) -> DataFrame:
    """Masked cells of every (design, alpha), see :func:`hidden` and :func:`masked_cells`."""
    return masked_cells(hidden(frame, study), study)


def manifest(masked: DataFrame, study: Study) -> DataFrame:
    """``cohort, design, alpha, n_rows, n_columns, n_missing, n_held_out, seed`` per unit."""
    per_column = masked.groupBy("cohort", "design", "alpha", "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("status") == REGISTRY_MISSING).alias("n_missing"),
        F.count_if(F.col("status") == HELD_OUT).alias("n_held_out"),
    )
    return per_column.groupBy("cohort", "design", "alpha").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_missing").alias("n_missing"), F.sum("n_held_out").alias("n_held_out"),
    ).withColumn("seed", unit_seed_column(study.masks.seed, F.col("cohort"), F.col("design")))
