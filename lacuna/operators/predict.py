"""Splits, model matrices and metrics of the outcome models.

``unit`` columns (cohort, target, arm, ...) ride along as grouping keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import as_number, hash_uniform
from lacuna.functions.frames import bounded, local_frame, pinned
from lacuna.functions.ordered import cut_points, grouped_quantiles, running_totals, up_to
from lacuna.operators.harmonise import as_binary
from lacuna.plans.schema import Codebook

SEEDS = (42, 314, 2718)
TEST_SHARE, VALIDATION_SHARE = 0.20, 0.25
MIN_ROWS = 50
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


# -- stratified splits ------------------------------------------------------


def _merge_small(bins: Column, min_count: int) -> Column:
    """Map bin -> merged bin: undersized bins flow upward; NULL when the last one stays undersized."""
    empty_open = F.array().cast("array<int>")
    empty_done = F.array().cast("array<struct<key:int,value:int>>")

    def step(state: Column, item: Column) -> Column:
        total = state["carry"] + item["n"]
        open_bins = F.concat(state["open"], F.array(item["bin"]))
        closed = F.concat(
            state["done"],
            F.transform(open_bins, lambda b: F.struct(b.alias("key"), item["bin"].alias("value"))),
        )
        return F.when(
            total >= min_count, F.struct(F.lit(0).cast("long").alias("carry"), empty_open.alias("open"), closed.alias("done"))
        ).otherwise(F.struct(total.alias("carry"), open_bins.alias("open"), state["done"].alias("done")))

    start = F.struct(F.lit(0).cast("long").alias("carry"), empty_open.alias("open"), empty_done.alias("done"))
    return F.aggregate(bins, start, step, lambda s: F.when(F.size(s["open"]) == 0, F.map_from_entries(s["done"])))


def strata(
    frame: DataFrame, unit: Sequence[str], y: str, *, n_bins: int = 10, min_count: int = 2, max_units: int
) -> DataFrame:
    """Add ``stratum``: the class of a two-valued target, else its quantile bin.

    Repeated quantile edges collapse, undersized bins merge upward, and a unit that
    cannot be stratified safely gets the single stratum 0.
    """
    counted = frame.groupBy(*unit, y).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(y).isNotNull())
    sizes = counted.groupBy(*unit).agg(F.count(F.lit(1)).alias("_distinct"), F.min(y).alias("_low"))
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = (
        grouped_quantiles(counted, unit, y, probs, weight="_n", max_groups=max_units)
        .groupBy(*unit).agg(F.sort_array(F.collect_set("quantile")).alias("_edges"))
    )
    rules = pinned(sizes.join(edges, list(unit)), max_units)
    below = F.size(F.filter("_edges", lambda e: e < F.col(y)))
    by_class = (F.col(y) > F.col("_low")).cast("int")
    bin_no = F.when(F.col("_distinct") == 2, by_class).otherwise(F.greatest(below - 1, F.lit(0)))
    bins = (
        counted.join(bounded(rules, max_units), list(unit)).withColumn("bin", bin_no)
        .groupBy(*unit, "_distinct", "bin").agg(F.sum("_n").alias("n"))
        .groupBy(*unit, "_distinct")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("_bins"))  # at most n_bins entries
    )
    plain = F.map_from_entries(F.transform("_bins", lambda s: F.struct(s["bin"].alias("key"), s["bin"].alias("value"))))
    small = F.array_min(F.transform("_bins", lambda s: s["n"])) < min_count
    merged = F.when(F.col("_distinct") == 2, F.when(~small, plain)).otherwise(_merge_small(F.col("_bins"), min_count))
    usable = F.when(F.size(F.array_distinct(F.map_values(merged))) >= 2, merged)
    lookup = pinned(bins.select(*unit, usable.alias("_merge")), max_units)
    joined = frame.join(bounded(rules, max_units), list(unit), "left").join(bounded(lookup, max_units), list(unit), "left")
    stratum = F.coalesce(F.element_at("_merge", bin_no), F.lit(0))
    return joined.withColumn("stratum", stratum).drop("_distinct", "_low", "_edges", "_merge")


def split_sizes(counts: DataFrame) -> DataFrame:
    """Add ``n_test`` and ``n_val`` to per-stratum counts ``n``: 20 %, then 25 % of the rest."""
    test = F.rint(F.col("n") * TEST_SHARE).cast("long")
    return counts.withColumn("n_test", test).withColumn(
        "n_val", F.rint((F.col("n") - F.col("n_test")) * VALIDATION_SHARE).cast("long")
    )


def split(
    frame: DataFrame, unit: Sequence[str], id_column: str, *, seeds: Sequence[int] = SEEDS, max_units: int,
    n_strata: int = 10,
) -> DataFrame:
    """Stratified train / validation / test per seed; needs ``stratum``.

    Rows take the order of a hash of (seed, id), so the folds do not depend on how
    the data is partitioned; the fold limits are found without ordering a stratum.
    """
    keys = [*unit, "stratum", "seed"]
    rows = max_units * n_strata * len(seeds)
    draws = local_frame(frame.sparkSession, [(int(s),) for s in seeds], "seed int")
    drawn = frame.crossJoin(F.broadcast(draws)).withColumn("_u", hash_uniform(F.col("seed"), F.col(id_column)))
    counts = frame.groupBy(*unit, "stratum").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(draws))
    sized = pinned(split_sizes(counts), rows)
    wanted = sized.select(*keys, F.inline(F.array(
        F.struct(F.lit("test").alias("tag"), F.col("n_test").alias("place")),
        F.struct(F.lit("val").alias("tag"), (F.col("n_test") + F.col("n_val")).alias("place")),
    )))
    cuts = cut_points(drawn, keys, "_u", id_column, wanted, pin_rows=2 * rows)
    ends = cuts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("tag") == t, F.col(c))).alias(f"_{t}_{c}") for t in ("test", "val") for c in ("cut", "cut_tie")
    ])
    joined = drawn.join(bounded(ends, rows), keys, "left")
    fold = (
        F.when(up_to("_u", id_column, "_test_cut", "_test_cut_tie"), "test")
        .when(up_to("_u", id_column, "_val_cut", "_val_cut_tie"), "val")
        .otherwise("train")
    )
    return joined.withColumn("fold", fold).drop("_u", *[f"_{t}_{c}" for t in ("test", "val") for c in ("cut", "cut_tie")])


# -- train-only down-sampling -----------------------------------------------


def downsampling_plan(
    frame: DataFrame, unit: Sequence[str], y: str, ratio: float = 3.0
) -> DataFrame:
    """Class counts of the train fold before and after, with the status and the class weight."""
    train = frame.filter("fold = 'train'").groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(F.col(y) == 1).alias("pos_before"), F.count_if(F.col(y) == 0).alias("neg_before"),
    )
    limit = F.greatest(F.col("pos_before"), F.ceil(F.col("pos_before") * float(ratio)))
    idle = (F.col("pos_before") == 0) | (F.col("neg_before") == 0) | F.lit(ratio <= 0)
    status = F.when(idle, "none").when(F.col("neg_before") <= limit, "not_needed").otherwise("train_fold_majority_0_downsampled")
    after = F.when(F.col("downsampling") == "train_fold_majority_0_downsampled", limit).otherwise(F.col("neg_before"))
    return train.withColumn("downsampling", status).withColumn("neg_after", after.cast("long")).withColumn(
        "pos_after", F.col("pos_before")
    ).withColumn(
        "class_weight", F.when(F.col("pos_after") > 0, F.col("neg_after") / F.col("pos_after")).otherwise(1.0)
    )


def downsample(
    frame: DataFrame, unit: Sequence[str], y: str, id_column: str, *, ratio: float = 3.0, max_units: int
) -> DataFrame:
    """Keep all rows but the surplus negatives of each train fold (hash order, seed + 1000)."""
    plan = pinned(downsampling_plan(frame, unit, y, ratio), max_units)
    order = hash_uniform(F.col("seed") + 1000, F.col(id_column))
    marked = frame.withColumn("_u", order).withColumn("_neg", (F.col("fold") == "train") & (F.col(y) == 0))
    wanted = plan.filter("neg_after < neg_before").select(*unit, F.lit("keep").alias("tag"), F.col("neg_after").alias("place"))
    cuts = cut_points(marked.filter("_neg"), unit, "_u", id_column, wanted, pin_rows=max_units)
    joined = marked.join(bounded(cuts.drop("tag"), max_units), list(unit), "left")
    keep = ~F.col("_neg") | F.col("cut").isNull() | up_to("_u", id_column)
    return joined.filter(keep).drop("_u", "_neg", "cut", "cut_tie")


def class_weight(weight: Column, entry: int) -> Column:
    """Positive-class weight of grid entry 1..3; the third takes a square root floored at 1."""
    return F.greatest(F.lit(1.0), F.sqrt(weight)) if entry == 3 else weight


# -- model matrix -----------------------------------------------------------


def model_groups(codebook: Codebook) -> dict[str, list[str]]:
    """Ordinals stay one ordered column next to the numbers."""
    return {
        "binary": codebook.of_kind("binary"),
        "continuous": codebook.of_kind("continuous", "count", "ordinal"),
        "multiclass": codebook.of_kind("nominal"),
    }


def infer_groups(frame: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Undeclared columns: binary when all values lie in {0, 1, 2}, otherwise continuous."""
    tests = frame.agg(*[
        F.bool_and(as_number(F.col(c)).isin(0.0, 1.0, 2.0)).alias(c) for c in columns
    ]).first() if columns else {}
    return {
        "binary": [c for c in columns if tests[c]],
        "continuous": [c for c in columns if not tests[c]],
        "multiclass": [],
    }


def model_matrix(frame: DataFrame, unit: Sequence[str], keep: Sequence[str], codebook: Codebook, *, max_units: int) -> DataFrame:
    """Numeric matrix per (unit, seed): binary 0/1, numbers z-scored by the train fold,
    nominal one-hot with a missing indicator. Needs ``fold``.

    A number without any observed train value becomes NULL throughout its unit. Codes of
    a binary are told unit by unit; a codebook without numbers or binaries is fine.
    """
    groups = model_groups(codebook)
    numbers = [c for c in groups["continuous"] if c in frame.columns]
    binaries = [c for c in groups["binary"] if c in frame.columns]
    joined = as_binary(frame, binaries, unit, max_units) if binaries else frame
    if numbers:
        train = frame.filter("fold = 'train'").groupBy(*unit).agg(*[
            x for c in numbers for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))
        ])
        joined = joined.join(bounded(pinned(train, max_units), max_units), list(unit), "left")
    out: list[Column] = [F.col(c).cast("double").alias(c) for c in binaries]
    for c in numbers:
        spread = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) <= 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
        out.append(((F.col(c) - F.col(f"_m_{c}")) / spread).alias(c))
    for c in groups["multiclass"]:
        if c in frame.columns:
            size = len(codebook[c].levels)
            out += [F.coalesce((F.col(c) == i).cast("double"), F.lit(0.0)).alias(f"{c}_{i}") for i in range(size)]
            out.append(F.col(c).isNull().cast("double").alias(f"{c}_missing"))
    return joined.select(*unit, *[k for k in keep if k not in unit], *out)


def empty_in_train(matrix: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without any value in the train fold; the caller drops them."""
    seen = matrix.filter("fold = 'train'").agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if not seen[c]]


def fill_for_trees(frame: DataFrame, columns: Sequence[str], fill: float = -99.0) -> DataFrame:
    """Tree input of the no-imputation arm: a constant outside the range plus a missing flag.

    The tree learners here reject NaN, so this stands in for native missing handling.
    """
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in columns}
    return frame.withColumns({**flags, **{c: F.coalesce(F.col(c), F.lit(fill)) for c in columns}})


# -- binary metrics ---------------------------------------------------------


def threshold_sweep(scores: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``unit, threshold, tp, fp, tn, fn, balanced_accuracy`` over the 19 thresholds.

    Rows are counted by how many thresholds they reach, then the 20 counts of a
    unit are accumulated; the scores are not multiplied by the thresholds.
    """
    reached = sum(((F.col("score") >= t).cast("int") for t in THRESHOLDS), F.lit(0))
    counts = scores.groupBy(*unit, reached.alias("_step"), "y").agg(F.count(F.lit(1)).alias("n"))
    per_unit = counts.groupBy(*unit).agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n_neg"),
        F.collect_list(F.struct("_step", "y", "n")).alias("_counts"),  # at most 20 x 2 entries
    )
    grid = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)])
    swept = per_unit.withColumn("_g", F.explode(grid)).withColumn("threshold", F.col("_g.threshold"))

    def reach(label: int) -> Column:
        hits = F.filter("_counts", lambda c: (c["_step"] >= F.col("_g.i")) & (c["y"] == label))
        return F.aggregate(hits, F.lit(0).cast("long"), lambda a, c: a + c["n"])

    swept = swept.withColumn("tp", reach(1)).withColumn("fp", reach(0))
    swept = swept.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n_neg") - F.col("fp"))
    return swept.select(*unit, "threshold", "tp", "fp", "tn", "fn", _balanced().alias("balanced_accuracy"))


def _balanced() -> Column:
    """Mean recall over the classes present."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    sens = F.when(pos > 0, F.col("tp") / pos)
    spec = F.when(neg > 0, F.col("tn") / neg)
    return F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2.0)


def best_threshold(scores: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``unit, threshold, balanced_accuracy``: the lowest of the best thresholds."""
    return threshold_sweep(scores, unit).groupBy(*unit).agg(
        F.min_by("threshold", F.struct(-F.col("balanced_accuracy"), F.col("threshold"))).alias("threshold"),
        F.max("balanced_accuracy").alias("balanced_accuracy"),
    )


def confusion_metrics(scores: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Counts and rates at the row's ``threshold`` in one aggregate."""
    hit = F.col("score") >= F.col("threshold")
    pos, neg = F.col("y") == 1, F.col("y") == 0
    counts = scores.groupBy(*unit).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fn"),
        F.count_if(neg & ~hit).alias("tn"), F.count_if(neg & hit).alias("fp"),
    )
    n = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return counts.withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / n,
        "balanced_accuracy": _balanced(),
        "sensitivity": F.when(n_pos > 0, F.col("tp") / n_pos),
        "specificity": F.when(n_neg > 0, F.col("tn") / n_neg),
        "false_negative_rate": F.when(n_pos > 0, F.col("fn") / n_pos),
        "below_075_balanced_accuracy": _balanced() < 0.75,
    })


def curve_metrics(scores: DataFrame, unit: Sequence[str], *, max_units: int | None = None) -> DataFrame:
    """``unit, roc_auc, au_prc, au_prc_lift, positive_rate``.

    ROC-AUC is the rank-sum form with ties at half; AU-PRC is the step sum of recall
    times precision over distinct scores. NULL where only one class occurs.
    """
    dist = scores.groupBy(*unit, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    run = running_totals(dist, unit, "score", ["pos", "neg"], max_groups=max_units)
    above_pos = F.col("all_pos") - F.col("before_pos")
    above = above_pos + F.col("all_neg") - F.col("before_neg")
    sums = run.groupBy(*unit).agg(
        F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"),
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("_wins"),
        F.sum(F.col("pos") * above_pos / above).alias("_steps"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    out = sums.withColumns({
        "roc_auc": F.when(both, F.col("_wins") / (F.col("_p") * F.col("_n"))),
        "au_prc": F.when(both, F.col("_steps") / F.col("_p")),
        "positive_rate": F.col("_p") / (F.col("_p") + F.col("_n")),
    })
    return out.withColumn("au_prc_lift", F.col("au_prc") / F.nullif(F.col("positive_rate"), F.lit(0.0))).drop(
        "_p", "_n", "_wins", "_steps"
    )


# -- regression metrics -----------------------------------------------------


def regression_metrics(scores: DataFrame, unit: Sequence[str], delta: float = 1.0) -> DataFrame:
    """Errors of ``pred`` against ``y``; ``mean`` and ``sd`` are the train-fold target scale."""
    error = F.col("y") - F.col("pred")
    z = error / F.col("sd")
    log_error = F.log1p(F.greatest(F.col("y"), F.lit(0.0))) - F.log1p(F.greatest(F.col("pred"), F.lit(0.0)))
    huber = delta**2 * (F.sqrt(1.0 + (z / delta) * (z / delta)) - 1.0)
    sums = scores.filter("y is not null and pred is not null").groupBy(*unit).agg(
        F.sqrt(F.avg(z * z)).alias("rmse_z"), F.avg(F.abs(z)).alias("mae_z"),
        F.sqrt(F.avg(error * error)).alias("rmse_original_units"), F.avg(F.abs(error)).alias("mae_original_units"),
        F.sqrt(F.avg(log_error * log_error)).alias("rmsle"), F.avg(huber).alias("mphe"),
        F.sum(error * error).alias("_sse"), F.var_pop("y").alias("_var"), F.count(F.lit(1)).alias("n_test"),
    )
    r2 = 1.0 - F.col("_sse") / F.nullif(F.col("_var") * F.col("n_test"), F.lit(0.0))
    return sums.withColumn("r2", r2).drop("_sse", "_var")


def target_profile(frame: DataFrame, unit: Sequence[str], y: str) -> DataFrame:
    """Train-fold facts that steer the continuous path: scale, zero share, skew, transforms."""
    train = frame.filter(F.col("fold") == "train").filter(F.col(y).isNotNull())
    n = F.col("n")
    stats = train.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("_sd"), F.min(y).alias("low"),
        F.skewness(y).alias("_g1"), F.count_if(F.col(y) > 0).alias("n_positive"), F.avg((F.col(y) <= 0).cast("double")).alias("_zero"),
    )
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    out = stats.withColumns({
        "sd": F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) <= 1e-12, 1.0).otherwise(F.col("_sd")),
        "skew": skew,
        "zero_fraction": F.when(F.col("low") >= 0, F.col("_zero")).otherwise(0.0),
    })
    return out.withColumns({
        "log1p_variant": (F.col("low") >= 0) & F.coalesce(F.col("skew") > 1.0, F.lit(False)),
        "hurdle": (F.col("zero_fraction") >= 0.40) & (F.col("n_positive") >= 20),
    }).drop("_sd", "_g1", "_zero")
