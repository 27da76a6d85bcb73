"""Summary tables over prediction records.

Records hold ``cohort, design, target, intensity, method, split_seed`` and metric
columns, one row per arm and split, so their number is that of the result grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.frames import bounded, require_empty
from lacuna.functions.ordered import grouped_quantiles

CELL = ["cohort", "design", "target", "intensity", "method", "split_seed"]
BASELINE = "Baseline"


def _quartiles(value: str | Column) -> Column:
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def collect_records(
    runs: DataFrame, *, binary: Sequence[str], continuous: Sequence[str], labels: dict[str, str] | None = None
) -> DataFrame:
    """Exploded result records to the record table; endpoints outside the two lists are left out."""
    named = F.coalesce(*[F.when(F.col("method") == k, F.lit(v)) for k, v in (labels or {}).items()], F.col("method"))
    error = F.col("error").isNull() if "error" in runs.columns else F.lit(True)
    return runs.filter(F.col("target").isin([*binary, *continuous])).select(
        "cohort", F.upper("design").alias("design"), "target",
        F.when(F.col("target").isin(list(binary)), "binary").otherwise("continuous").alias("target_type"),
        F.rint(F.col("alpha") * 100).cast("int").alias("intensity"),
        named.alias("method"), F.col("method").alias("method_key"), "split_repeat", F.col("seed").alias("split_seed"),
        F.when(error, "ok").otherwise("error").alias("status"),
        *[c for c in runs.columns if c not in (
            "cohort", "design", "target", "alpha", "method", "split_repeat", "seed", "error", "is_binary", "source_file")],
    )


def duplicate_cells(records: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique_cells(records: DataFrame) -> None:
    require_empty(duplicate_cells(records), "duplicated result cells")


def _baseline_median(records: DataFrame, value: str, baseline: str) -> DataFrame:
    return records.filter(F.col("method") == baseline).groupBy("target").agg(
        F.percentile(value, F.lit(0.5)).alias("_base")
    )


def baseline_delta(records: DataFrame, value: str, baseline: str = BASELINE) -> DataFrame:
    """Value minus the median of the target's baseline arm."""
    joined = records.join(_baseline_median(records, value, baseline), "target", "left")
    return joined.withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def baseline_ratio(records: DataFrame, value: str, baseline: str = BASELINE) -> DataFrame:
    """Value over the median of the target's baseline arm; NULL for a zero median."""
    joined = records.join(_baseline_median(records, value, baseline), "target", "left")
    return joined.withColumn("ratio", F.col(value) / F.nullif(F.col("_base"), F.lit(0.0))).drop("_base")


def box_summary(
    records: DataFrame, by: Sequence[str], value: str, *, lower_is_better: bool, baseline: str = BASELINE
) -> DataFrame:
    """n, mean, quartiles, whiskers at 1.5 IQR and whether the median beats the baseline's."""
    keys = [*by, "method"]
    stats = records.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), _quartiles(value).alias("_q")
    ).select(*keys, "n", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    whiskers = records.join(stats, keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high")
    )
    base = stats.filter(F.col("method") == baseline).select(*by, F.col("median").alias("_base"))
    joined = stats.join(whiskers, keys)
    joined = joined.join(base, list(by), "left") if by else joined.crossJoin(F.broadcast(base))
    better = F.col("median") < F.col("_base") if lower_is_better else F.col("median") > F.col("_base")
    return joined.withColumn("better_than_reference", (F.col("method") != baseline) & F.coalesce(better, F.lit(False))).drop("_base")


def caption_facts(boxes: DataFrame, by: Sequence[str], *, lower_is_better: bool, baseline: str = BASELINE) -> DataFrame:
    """Best arm besides the baseline, the arms beating it, and the range of n per box."""
    key = F.col("median") if lower_is_better else -F.col("median")
    other = F.col("method") != baseline
    return boxes.groupBy(*by).agg(
        F.min_by("method", F.when(other, F.struct(key, F.col("method")))).alias("best_method"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("better_than_reference"), F.col("method")))), ";").alias("better_methods"),
        F.min("n").alias("min_n"), F.max("n").alias("max_n"),
    )


def target_medians(records: DataFrame, value: str, cohorts: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Median per method, one column per ``<cohort>_<target>``."""
    picks = [
        F.percentile(F.when((F.col("cohort") == c) & (F.col("target") == t), F.col(value)), F.lit(0.5)).alias(f"{c}_{t}")
        for c in cohorts for t in targets
    ]
    return records.groupBy("method").agg(*picks)


def error_profile(records: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Summed errors per cohort and arm, rates from the sums, change against the baseline in percent."""
    sums = records.groupBy("cohort", "method").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "tn", "fp")])
    base = sums.filter(F.col("method") == baseline).select("cohort", F.col("fn").alias("_fn"), F.col("fp").alias("_fp"))

    def share(top: str, other: str) -> Column:
        return F.col(top) / F.greatest(F.col(top) + F.col(other), F.lit(1))

    def change(c: str) -> Column:
        return 100.0 * (F.col(c) - F.col(f"_{c}")) / F.nullif(F.col(f"_{c}"), F.lit(0))

    return sums.join(base, "cohort", "left").withColumns({
        "sensitivity": share("tp", "fn"), "specificity": share("tn", "fp"), "ppv": share("tp", "fp"),
        "delta_fn_pct": change("fn"), "delta_fp_pct": change("fp"),
    }).drop("_fn", "_fp")


def class_counts(records: DataFrame) -> DataFrame:
    """Distinct train class counts before and after down-sampling per target and split."""
    return records.select(
        "cohort", "target", "split_seed", "pos_before", "neg_before", "pos_after", "neg_after"
    ).distinct()


def false_negative_summary(records: DataFrame) -> DataFrame:
    """False negatives summed over targets per (design, intensity, split), then summarised per
    cohort, method and intensity. The mechanism is part of the key."""
    sums = records.groupBy("cohort", "design", "method", "intensity", "split_seed").agg(
        F.sum("fn").alias("fn"), F.sum(F.col("tp") + F.col("fn")).alias("pos")
    ).withColumn("rate", F.col("fn") / F.nullif(F.col("pos"), F.lit(0)))
    out = sums.groupBy("cohort", "method", "intensity").agg(
        F.count(F.lit(1)).alias("n"), _quartiles("fn").alias("_q"), F.min("fn").alias("fn_min"), F.max("fn").alias("fn_max"),
        F.percentile("rate", F.lit(0.5)).alias("rate_median"),
    )
    return out.select(
        "cohort", "method", "intensity", "n", F.col("_q")[1].alias("fn_median"), F.col("_q")[0].alias("fn_q1"),
        F.col("_q")[2].alias("fn_q3"), "fn_min", "fn_max", "rate_median",
    )


def compact_summary(records: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n and median / quartiles of each value column."""
    aggs = [F.count(F.lit(1)).alias("n")] + [_quartiles(v).alias(f"_{v}") for v in values]
    out = records.groupBy(*by).agg(*aggs)
    picks = [
        F.col(f"_{v}")[i].alias(f"{v}_{name}") for v in values for i, name in ((1, "median"), (0, "q1"), (2, "q3"))
    ]
    return out.select(*by, "n", *picks)


def first_metric(records: DataFrame, metrics: Sequence[str], baseline: str = BASELINE) -> DataFrame:
    """First available metric per row, its ratio to the target's baseline median, and per
    method the coefficient of variation in percent."""
    chosen = records.withColumn("metric_value", F.coalesce(*[F.col(m) for m in metrics]))
    ratio = baseline_ratio(chosen, "metric_value", baseline)
    spread = 100.0 * F.stddev_samp("metric_value") / F.nullif(F.abs(F.avg("metric_value")), F.lit(0.0))
    return ratio.groupBy("target", "method").agg(
        F.percentile("ratio", F.lit(0.5)).alias("ratio_median"), spread.alias("cv_pct"), F.count("metric_value").alias("n")
    )


def mean_sd(records: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return records.groupBy(*by).agg(*[
        x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))
    ])


# -- endpoint distributions (over data rows) --------------------------------


def binary_distribution(frame: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    n = F.count(F.lit(1))
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return frame.groupBy(*by).agg(
        n.alias("n"), pos.alias("n_positive"), neg.alias("n_negative"), F.count_if(F.col(y).isNull()).alias("n_missing"),
        (100.0 * pos / F.nullif(F.count(F.col(y)), F.lit(0))).alias("positive_pct"),
        (100.0 * neg / F.nullif(F.count(F.col(y)), F.lit(0))).alias("negative_pct"),
    )


def continuous_profile(frame: DataFrame, by: Sequence[str], y: str, *, max_groups: int | None = None) -> DataFrame:
    base = frame.groupBy(*by).agg(
        F.count(F.col(y)).alias("n"), F.count_if(F.col(y).isNull()).alias("n_missing"),
        F.max(y).alias("max"), F.count_if(F.col(y) == 0).alias("n_zero"),
    )
    median = grouped_quantiles(frame, by, y, [0.5], max_groups=max_groups).select(*by, F.col("quantile").alias("median"))
    return base.join(median, list(by), "left")


def standardised_histogram(
    frame: DataFrame, by: Sequence[str], y: str, *, bins: int = 42, max_groups: int | None = None
) -> DataFrame:
    """``by, bin, n`` of the z-scored values over ``bins`` equal bins; the last bin is closed on the right."""
    stats = frame.groupBy(*by).agg(
        F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"), F.min(y).alias("_lo"), F.max(y).alias("_hi")
    )
    z = (F.col(y) - F.col("_m")) / F.col("_s")
    low, high = (F.col("_lo") - F.col("_m")) / F.col("_s"), (F.col("_hi") - F.col("_m")) / F.col("_s")
    place = F.least(F.floor((z - low) / ((high - low) / bins)), F.lit(bins - 1))
    known = frame.filter(F.col(y).isNotNull())
    joined = known.join(bounded(stats, max_groups), list(by)) if by else known.crossJoin(F.broadcast(stats))
    return joined.filter("_s > 0").groupBy(*by, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- ranking tables ---------------------------------------------------------


def mean_rank_table(tests: DataFrame, family: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """One row per family, one column of mean ranks per arm."""
    return tests.select(*family, "chi2", *[F.element_at("mean_ranks", F.lit(a)).alias(a) for a in arms])


def surviving_pairs(pairs: DataFrame, family: Sequence[str]) -> DataFrame:
    """Significant pairs with the blocks the better arm won."""
    won = F.when(F.col("better_arm") == F.col("arm_a"), F.col("n_blocks_favouring_a")).otherwise(
        F.col("n_nonzero_differences") - F.col("n_blocks_favouring_a")
    )
    return pairs.filter("reject_holm").select(
        *family, "better_arm", "worse_arm", won.alias("blocks_won"), "n_complete_blocks", "median_diff_a_minus_b", "p_holm"
    )


def rank_positions(values: DataFrame, by: Sequence[str], value: str, *, lower_is_better: bool) -> DataFrame:
    """Position with ties 1, 2, 2, 4 within each group of arms."""
    order = F.col(value) if lower_is_better else F.col(value).desc()
    return values.withColumn("position", F.rank().over(Window.partitionBy(*by).orderBy(order)))
