"""Paired comparison of arms over blocks, many families in one job.

``family`` columns separate independent comparisons; they ride along as grouping
keys. Input frames hold ``family..., block..., arm, value``. One block holds one
value per arm, so block-local windows are as wide as the declared list of arms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.frames import pinned
from lacuna.functions.ordered import grouped_quantiles, running_totals
from lacuna.functions.tails import chi2_sf, signed_rank_p

TEST_ROWS = 100_000  # families in one job
LOWER, HIGHER = "lower_is_better", "higher_is_better"


def paired_blocks(
    scores: DataFrame, family: Sequence[str], blocks: Sequence[str], arms: Sequence[str]
) -> DataFrame:
    """Long form of the complete blocks: mean per block and arm, kept where every arm
    is present; ``n_blocks_total`` counts all blocks of the family."""
    keys = [*family, *blocks]
    absent = [c for c in (*keys, "arm", "value") if c not in scores.columns]
    if absent:
        raise KeyError(f"missing column(s) for pairing: {absent}")
    means = scores.groupBy(*keys, "arm").agg(F.avg(F.col("value").cast("double")).alias("value"))
    listed = means.filter(F.col("arm").isin(list(arms)) & F.col("value").isNotNull())
    counted = listed.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    complete = counted.filter(F.col("_k") == len(arms)).drop("_k")
    totals = means.select(*keys).distinct().groupBy(*family).agg(F.count(F.lit(1)).alias("n_blocks_total"))
    return complete.join(totals, list(family)) if family else complete.crossJoin(F.broadcast(totals))


def paired_matrix(scores: DataFrame, family: Sequence[str], blocks: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """Wide ``family, blocks, <arm>...`` of the complete blocks."""
    picks = [F.max(F.when(F.col("arm") == a, F.col("value"))).alias(a) for a in arms]
    return paired_blocks(scores, family, blocks, arms).groupBy(*family, *blocks).agg(*picks)


def _oriented(direction: str | Column) -> Column:
    sign = F.when(F.lit(direction) == LOWER, 1.0).otherwise(-1.0) if isinstance(direction, str) else (
        F.when(direction == LOWER, 1.0).otherwise(-1.0)
    )
    return sign * F.col("value")


def average_rank(order: Window, ties: Window) -> Column:
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def block_ranks(complete: DataFrame, keys: Sequence[str], direction: str | Column) -> DataFrame:
    """Average ranks within each block, 1 = best; ``ties`` is the size of the arm's tie group."""
    out = complete.withColumn("_key", _oriented(direction))
    block = Window.partitionBy(*keys)
    tied = Window.partitionBy(*keys, "_key")
    return out.withColumns({
        "rank": average_rank(block.orderBy("_key"), tied), "ties": F.count(F.lit(1)).over(tied),
    }).drop("_key")


def arm_summary(ranks: DataFrame, family: Sequence[str]) -> DataFrame:
    """``family, arm, mean_rank, median, n_complete_blocks, rank_sum`` with exact medians."""
    keys = [*family, "arm"]
    base = ranks.groupBy(*keys).agg(
        F.avg("rank").alias("mean_rank"), F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n_complete_blocks"),
        F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_sum"),
        F.first("n_blocks_total").alias("n_blocks_total"),
    )
    medians = grouped_quantiles(ranks, keys, "value", [0.5]).select(*keys, F.col("quantile").alias("median"))
    return base.join(medians, keys)


def friedman(summary: DataFrame, family: Sequence[str], direction: str | Column) -> DataFrame:
    """Tie-corrected chi-square per family with the effect size.

    Takes :func:`arm_summary`. Families with fewer than three arms or three complete
    blocks are reported as skipped. ``spread_pct`` is the range of the medians over
    the median of their absolute values.
    """
    k, n = F.col("n_arms"), F.col("n_complete_blocks")
    agg = summary.withColumn("_dir", direction if isinstance(direction, Column) else F.lit(direction))
    best_key = F.when(F.col("_dir") == LOWER, F.col("median")).otherwise(-F.col("median"))
    out = agg.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_arms"), F.max("n_complete_blocks").alias("n_complete_blocks"),
        F.max("n_blocks_total").alias("n_blocks_total"),
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("_ss"), F.sum("tie_sum").alias("_ties"),
        F.min_by("arm", F.struct(best_key, F.col("arm"))).alias("best_median_arm"),
        F.min_by("arm", F.struct(F.col("mean_rank"), F.col("arm"))).alias("best_mean_rank_arm"),
        F.max("median").alias("_hi"), F.min("median").alias("_lo"),
        F.percentile(F.abs("median"), F.lit(0.5)).alias("_ref"),
        F.sort_array(F.collect_list(F.struct("arm", "mean_rank"))).alias("_ranks"),
        F.sort_array(F.collect_list(F.struct("arm", "median"))).alias("_medians"),
    )
    # Each member of a tie group of size t adds t*t-1, so the group adds t^3-t.
    correction = 1.0 - F.col("_ties") / (n * k * (k * k - 1.0))
    raw = 12.0 / (n * k * (k + 1.0)) * F.col("_ss") - 3.0 * n * (k + 1.0)
    enough = (k >= 3) & (n >= 3)
    chi2 = F.when(enough & (correction > 0), raw / correction)
    return out.withColumns({
        "chi2": chi2,
        "status": F.when(k < 3, "skipped: fewer than 3 arms").when(n < 3, "skipped: fewer than 3 complete blocks").otherwise("ok"),
        "spread_pct": F.when(enough & (F.col("_ref") > 0), (F.col("_hi") - F.col("_lo")) / F.col("_ref") * 100.0),
        "mean_ranks": F.map_from_entries("_ranks"),
        "medians": F.map_from_entries("_medians"),
    }).drop("_ss", "_ties", "_hi", "_lo", "_ref", "_ranks", "_medians")


def with_chi2_p(tests: DataFrame, df_column: str = "n_arms") -> DataFrame:
    """Add ``p_value`` with df = arms - 1. Arrow batches; one row per test."""
    schema = T.StructType([*tests.schema.fields, T.StructField("p_value", T.DoubleType())])

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p_value"] = [
                chi2_sf(None if pd.isna(x) else float(x), int(k) - 1) for x, k in zip(batch["chi2"], batch[df_column])
            ]
            batch["p_value"] = batch["p_value"].astype("float64")
            yield batch

    return tests.mapInPandas(tail, schema)


def holm(tests: DataFrame, family: Sequence[str], p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family of tests; NULL passes through.

    A family is a list of tests (pairs of arms, or families of a study).
    """
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*family, known)
    order = group.orderBy(p)
    step = (F.count(F.lit(1)).over(group) - F.row_number().over(order) + 1) * F.col(p)
    stepped = tests.withColumn("_step", step)
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(out, F.when(known, F.least(F.lit(1.0), running))).drop("_step")


def pair_differences(complete: DataFrame, family: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """``family, blocks, arm_a, arm_b, a, b, diff``: arms of a block side by side.

    The arms of one block are gathered into a sorted array (as long as the declared
    arm list) and its pairs unfolded, so no self-join is needed.
    """
    rows = complete.groupBy(*family, *blocks).agg(F.sort_array(F.collect_list(F.struct("arm", "value"))).alias("_arms"))
    pairs = F.flatten(F.transform(
        "_arms",
        lambda x, i: F.transform(
            F.slice(F.col("_arms"), i + 2, F.size("_arms")),
            lambda y: F.struct(
                x["arm"].alias("arm_a"), y["arm"].alias("arm_b"), x["value"].alias("a"), y["value"].alias("b")
            ),
        ),
    ))
    return rows.select(*family, *blocks, F.inline(pairs)).withColumn("diff", F.col("a") - F.col("b"))


def pairwise_wilcoxon(complete: DataFrame, family: Sequence[str], blocks: Sequence[str], direction: str | Column) -> DataFrame:
    """Signed-rank statistic of every pair of arms, without the p-value.

    Ranks of |diff| come from running totals over its distinct values, so a pair
    with many blocks is not ordered in one task.
    """
    keys = [*family, "arm_a", "arm_b"]
    # A family-level direction column must survive the pair rows.
    diffs = pair_differences(complete, family, blocks)
    lower = (F.lit(direction) if isinstance(direction, str) else direction) == LOWER
    favours = F.when(lower, F.col("diff") < 0).otherwise(F.col("diff") > 0)
    base = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_complete_blocks"), F.count_if(F.col("diff") != 0).alias("n_nonzero_differences"),
        F.count_if(favours).alias("n_blocks_favouring_a"),
    )
    sizes = diffs.filter("diff <> 0").groupBy(*keys, F.abs("diff").alias("_d")).agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(F.col("diff") > 0).alias("_pos")
    )
    ranked = running_totals(sizes, keys, "_d", ["_t"]).withColumn("_rank", F.col("before__t") + (F.col("_t") + 1) / 2.0)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_rank") * F.col("_pos")).alias("_plus"),
        F.sum(F.col("_rank") * (F.col("_t") - F.col("_pos"))).alias("_minus"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    sides = diffs.select(
        *keys, F.stack(F.lit(3), F.lit("a"), F.col("a"), F.lit("b"), F.col("b"), F.lit("diff"), F.col("diff")).alias("side", "value")
    )
    med = grouped_quantiles(sides, [*keys, "side"], "value", [0.5]).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "a", F.col("quantile"))).alias("median_a"),
        F.max(F.when(F.col("side") == "b", F.col("quantile"))).alias("median_b"),
        F.max(F.when(F.col("side") == "diff", F.col("quantile"))).alias("median_diff_a_minus_b"),
    )
    delta = F.col("median_diff_a_minus_b")
    a_better = F.when(lower, delta < 0).otherwise(delta > 0)
    return base.join(med, keys).join(sums, keys, "left").select(
        *keys, "n_complete_blocks", "n_nonzero_differences", "n_blocks_favouring_a",
        "median_a", "median_b", "median_diff_a_minus_b",
        F.when(delta != 0, F.when(a_better, F.col("arm_a")).otherwise(F.col("arm_b"))).alias("better_arm"),
        F.when(delta != 0, F.when(a_better, F.col("arm_b")).otherwise(F.col("arm_a"))).alias("worse_arm"),
        F.least("_plus", "_minus").alias("wilcoxon_statistic"), F.coalesce("tie_term", F.lit(0.0)).alias("tie_term"),
    )


def with_signed_rank_p(pairs: DataFrame) -> DataFrame:
    schema = T.StructType([*pairs.schema.fields, T.StructField("p_value", T.DoubleType())])

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p_value"] = [
                signed_rank_p(None if pd.isna(w) else float(w), int(n), float(t), int(m) - int(n))
                for w, n, t, m in zip(
                    batch["wilcoxon_statistic"], batch["n_nonzero_differences"], batch["tie_term"], batch["n_complete_blocks"]
                )
            ]
            batch["p_value"] = batch["p_value"].astype("float64")
            yield batch

    return pairs.mapInPandas(tail, schema)


def require_blocks(tests: DataFrame, expected: int | Column) -> None:
    """Raise when a family's complete-block count is not the designed one."""
    want = F.lit(expected) if isinstance(expected, int) else expected
    wrong = tests.filter(F.col("n_complete_blocks") != want).limit(5).collect()
    if wrong:
        raise AssertionError(f"unexpected number of complete blocks: {[r.asDict() for r in wrong]}")


def omnibus(
    scores: DataFrame, family: Sequence[str], blocks: Sequence[str], arms: Sequence[str], direction: str | Column,
    *, alpha: float = 0.05, holm_over: Sequence[str] | None = None,
) -> DataFrame:
    """Friedman per family with p; ``reject`` uses the Holm-adjusted p when ``holm_over`` is given."""
    complete = paired_blocks(scores, family, blocks, arms)
    ranks = block_ranks(complete, [*family, *blocks], direction)
    tests = with_chi2_p(friedman(arm_summary(ranks, family), family, direction))
    if holm_over is None:
        return tests.withColumn("reject", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return holm(tests, holm_over).withColumn("reject", F.coalesce(F.col("p_holm") < alpha, F.lit(False)))


def compare_arms(
    scores: DataFrame, family: Sequence[str], blocks: Sequence[str], arms: Sequence[str], direction: str | Column,
    *, alpha: float = 0.05, expected_blocks: int | None = None, correct_families: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Omnibus first; pairs only for the families whose omnibus rejects."""
    tests = omnibus(scores, family, blocks, arms, direction, alpha=alpha, holm_over=[] if correct_families else None)
    if expected_blocks is not None:
        require_blocks(tests, expected_blocks)
    tests = pinned(tests, TEST_ROWS)
    survivors = tests.filter("reject").select(*family)
    complete = paired_blocks(scores, family, blocks, arms)
    if family:
        complete = complete.join(survivors, list(family), "left_semi")
    elif not survivors.limit(1).collect():
        complete = complete.limit(0)
    pairs = holm(with_signed_rank_p(pairwise_wilcoxon(complete, family, blocks, direction)), family)
    return tests, pairs.withColumn("reject_holm", F.coalesce(F.col("p_holm") < alpha, F.lit(False)))


def ranking(tests: DataFrame, family: Sequence[str], *, top: int = 3) -> DataFrame:
    """``family, arm, mean_rank, position, top``: positions with ties 1, 2, 2, 4; the top
    flag only where the omnibus survives."""
    arms = tests.select(*family, "reject", F.explode("mean_ranks").alias("arm", "mean_rank"))
    place = F.rank().over(Window.partitionBy(*family).orderBy("mean_rank"))
    return arms.withColumn("position", place).select(
        *family, "arm", "mean_rank", "position", (F.col("reject") & (F.col("position") <= top)).alias("top")
    )


def ranking_ends(tests: DataFrame) -> DataFrame:
    """First, second and last arm by mean rank, and the spread between first and last."""
    entries = F.sort_array(F.transform(F.map_entries("mean_ranks"), lambda e: F.struct(e["value"].alias("r"), e["key"].alias("a"))))
    out = tests.withColumn("_o", entries)
    last = F.element_at("_o", -1)
    return out.withColumns({
        "rank1": F.get("_o", F.lit(0))["a"], "rank1_mean_rank": F.get("_o", F.lit(0))["r"],
        "rank2": F.get("_o", F.lit(1))["a"], "rank2_mean_rank": F.get("_o", F.lit(1))["r"],
        "rank_last": last["a"], "rank_last_mean_rank": last["r"],
        "rank_spread": last["r"] - F.get("_o", F.lit(0))["r"],
    }).drop("_o")


def pairwise_counts(tests: DataFrame, pairs: DataFrame, family: Sequence[str]) -> DataFrame:
    """Tests and significant pairs per family, zero where no pairs were opened."""
    n = pairs.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_pairwise_tested"), F.count_if("reject_holm").alias("n_pairwise_significant")
    )
    return tests.join(n, list(family), "left").fillna(0, ["n_pairwise_tested", "n_pairwise_significant"])
