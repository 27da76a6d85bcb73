"""How well an imputer recovers the hidden cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import hash_digits, hash_reaches
from lacuna.plans.schema import CATEGORICAL, HELD_OUT, NUMERIC

ARM = ["cohort", "design", "alpha", "method"]
VARIABLE_TYPE = {"balanced_acc": "Categorical", "rmse": "Continuous"}


def held_out_pairs(cells: DataFrame) -> DataFrame:
    """Hidden cells where both the truth and the imputed value exist."""
    return cells.filter((F.col("status") == HELD_OUT) & F.col("truth").isNotNull() & F.col("imputed").isNotNull())


def dropped_pairs(cells: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """Hidden cells an imputer left open, per arm and feature."""
    return (
        cells.filter(F.col("status") == HELD_OUT)
        .groupBy(*by, "feature").agg(F.count_if(F.col("imputed").isNull()).alias("n_dropped"))
    )


def rmse(cells: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    error = F.col("truth") - F.col("imputed")
    return (
        held_out_pairs(cells).filter(F.col("kind").isin(*NUMERIC))
        .groupBy(*by, "feature").agg(F.sqrt(F.avg(error * error)).alias("value"))
    )


def confusion(cells: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """``by, feature, t, p, n``: one pass, the base of all categorical metrics."""
    return (
        held_out_pairs(cells).filter(F.col("kind").isin(*CATEGORICAL))
        .groupBy(*by, "feature", F.col("truth").cast("int").alias("t"), F.col("imputed").cast("int").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def categorical_metrics(table: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """``by, feature, accuracy, f1_macro, balanced_acc`` from confusion counts.

    Macro-F1 averages over labels seen in the truth or the prediction (0 where
    undefined); balanced accuracy averages recall over labels present in the truth.
    """
    keys = [*by, "feature"]
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("n_true"), F.lit(0).cast("long").alias("n_pred"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("n_true"), F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("tp")),
    ))
    per_label = table.select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum("s.n_true").alias("n_true"), F.sum("s.n_pred").alias("n_pred"), F.sum("s.tp").alias("tp")
    )
    f1 = 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))
    recall = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))
    return per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
        F.avg(recall).alias("balanced_acc"),
    )


def fidelity(cells: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """Tidy ``by, metric, feature, value`` for every arm in the frame."""
    names = ["accuracy", "f1_macro", "balanced_acc"]
    metrics = categorical_metrics(confusion(cells, by), by)
    args = [x for n in names for x in (F.lit(n), F.col(n))]
    tidy = metrics.select(*by, "feature", F.stack(F.lit(len(names)), *args).alias("metric", "value"))
    numeric = rmse(cells, by).withColumn("metric", F.lit("rmse"))
    return tidy.unionByName(numeric).select(*by, "metric", "feature", "value")


# -- the long table with its guards -----------------------------------------


def reported(values: DataFrame) -> DataFrame:
    """The two metrics that are reported, with their variable type and simulation label."""
    kind = F.when(F.col("metric") == "rmse", "Continuous").otherwise("Categorical")
    percent = F.rint(F.col("alpha") * 100).cast("int")
    return values.filter(F.col("metric").isin(*VARIABLE_TYPE)).filter("value is not null").select(
        "*", kind.alias("variable_type"), percent.alias("intensity"),
        F.concat(F.upper("design"), percent.cast("string")).alias("simulation"),
    )


def grid_violations(values: DataFrame, expected: DataFrame, *, ensemble: DataFrame | None = None) -> DataFrame:
    """``cohort, design, alpha, method, problem`` for everything that breaks the grid.

    ``expected`` lists the (cohort, design, alpha, method) arms that must exist.
    Within a unit every method must have scored the same features, each once, with
    finite values, none of them a dummy column. ``ensemble`` optionally gives
    ``method, n_ensemble, n_expected``.
    """
    unit = ["cohort", "design", "alpha"]

    def problem(frame: DataFrame, text: str) -> DataFrame:
        return frame.select(*unit, "method", F.lit(text).alias("problem"))

    missing = problem(expected.join(values.select(*ARM).distinct(), ARM, "left_anti"), "arm missing")
    repeated = problem(
        values.groupBy(*ARM, "metric", "feature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate score"
    )
    infinite = problem(values.filter(F.isnan("value") | (F.abs("value") == float("inf"))), "non-finite score")
    dummies = problem(values.filter(F.col("feature").contains("__")), "one-hot column scored")
    # Features scored by some method of the unit, against those of each method.
    methods = values.select(*ARM).distinct()
    scored = values.select(*unit, "metric", "feature").distinct()
    uneven = problem(
        scored.join(methods, unit).join(
            values.select(*ARM, "metric", "feature"), [*ARM, "metric", "feature"], "left_anti"
        ),
        "feature set differs",
    )
    out = missing.unionByName(repeated).unionByName(infinite).unionByName(dummies).unionByName(uneven)
    if ensemble is not None:
        wrong = methods.join(ensemble.filter("n_ensemble <> n_expected"), "method", "left_semi")
        out = out.unionByName(problem(wrong, "ensemble size"))
    return out.distinct()


def summarise(values: DataFrame, by: Sequence[str] = ("cohort", "variable_type", "metric", "method")) -> DataFrame:
    """Mean, median and quartiles over the scored features and units of each method.

    Groups here are cells of the result grid (features x units), not data rows.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return values.groupBy(*by).agg(
        F.avg("value").alias("mean"), q.alias("_q"), F.count("value").alias("n_values")
    ).select(
        *by, "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), "n_values"
    )


# -- bootstrap --------------------------------------------------------------


def bootstrap(
    cells: DataFrame, id_column: str, by: Sequence[str] = ARM, *,
    resamples: int = 100, fraction: float = 0.25, seed: int = 20260507,
) -> DataFrame:
    """RMSE and accuracy per resample of the records: ``by, feature, resample, metric, value``.

    A record's weight in a resample is Poisson(fraction) from a hash of (seed, resample,
    record), the distributed form of drawing with replacement; all cells of a record
    share it. Each cell is expanded only into the resamples it falls into.
    """
    # Poisson by inversion, up to where what is left is below the step of the uniform.
    below, term, bounds = 0.0, math.exp(-fraction), []
    while len(bounds) <= fraction or 1.0 - below > 1e-14:
        below += term
        bounds.append(below)
        term *= fraction / len(bounds)
    weight = sum((hash_reaches(F.col("_h"), b).cast("int") for b in bounds), F.lit(0))
    pairs = held_out_pairs(cells).select(*by, id_column, "feature", "kind", "truth", "imputed")
    drawn = pairs.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    # One comparison drops what is not drawn; the copies of the rest are counted on a hash that is made once.
    drawn = drawn.withColumn("_h", hash_digits(F.lit(seed), F.col("_b"), F.col(id_column)))
    drawn = drawn.filter(hash_reaches(F.col("_h"), bounds[0])).withColumn("_w", weight)
    numeric = F.col("kind").isin(*NUMERIC)
    error = F.col("truth") - F.col("imputed")
    loss = F.when(numeric, error * error).otherwise((F.col("truth") == F.col("imputed")).cast("double"))
    sums = drawn.groupBy(*by, "feature", "kind", F.col("_b").alias("resample")).agg(
        (F.sum(loss * F.col("_w")) / F.sum("_w")).alias("_mean")
    )
    return sums.select(
        *by, "feature", "resample", F.when(numeric, "rmse").otherwise("accuracy").alias("metric"),
        F.when(numeric, F.sqrt("_mean")).otherwise(F.col("_mean")).alias("value"),
    )


def bootstrap_intervals(samples: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """95 % interval and quartiles over the resamples of each arm and feature."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.025, 0.25, 0.5, 0.75, 0.975)]))
    names = ["ci_low", "q1", "median", "q3", "ci_high"]
    out = samples.groupBy(*by, "metric", "feature").agg(q.alias("_q"), F.count("value").alias("n_resamples"))
    return out.select(*by, "metric", "feature", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "n_resamples")
