"""Canonical (z-scored) space, model space in [0, 1], and the way back.

Fits return parameter tables with one row per unit and feature; applying them is
a lookup join against a table the schema bounds, so the cells are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import clip
from lacuna.functions.frames import bounded, pinned
from lacuna.functions.ordered import grouped_quantiles
from lacuna.plans.schema import NUMERIC, Codebook

KNOTS = 1000


# -- canonical space --------------------------------------------------------


def fit_canonical(
    cells: DataFrame, unit: Sequence[str], *, value: str = "value",
    kinds: Sequence[str] = NUMERIC, min_scale: float = 1e-9,
) -> DataFrame:
    """``unit, feature, mean, scale, degenerate`` over the observed cells.

    All-missing gives (0, 1); a scale below ``min_scale`` becomes 1 and is flagged.
    """
    stats = cells.filter(F.col("kind").isin(list(kinds))).groupBy(*unit, "feature").agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")
    )
    flat = F.coalesce(F.col("_sd"), F.lit(0.0)) < min_scale
    return stats.select(
        *unit, "feature",
        F.coalesce("_mean", F.lit(0.0)).alias("mean"),
        F.when(flat, 1.0).otherwise(F.col("_sd")).alias("scale"),
        flat.alias("degenerate"),
    )


def _with_scaler(cells: DataFrame, scaler: DataFrame, unit: Sequence[str], rows: int | None) -> DataFrame:
    lookup = scaler.select(*unit, "feature", F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))
    return cells.join(bounded(lookup, rows), [*unit, "feature"], "left")


def _scaled(apply: Column, column: Column, kinds: Sequence[str]) -> Column:
    needs = F.col("kind").isin(list(kinds))
    absent = F.raise_error(F.concat(F.lit("no scaler for column "), F.col("feature"))).cast("double")
    return F.when(~needs, column).when(F.col("_scale").isNull(), absent).otherwise(apply)


def apply_canonical(
    cells: DataFrame, scaler: DataFrame, unit: Sequence[str], values: Sequence[str] = ("value",), *,
    kinds: Sequence[str] = NUMERIC, rows: int | None = None,
) -> DataFrame:
    """z-score the listed value columns; a feature without parameters is an error."""
    joined = _with_scaler(cells, scaler, unit, rows)
    return joined.withColumns({
        v: _scaled((F.col(v) - F.col("_mean")) / F.col("_scale"), F.col(v), kinds) for v in values
    }).drop("_mean", "_scale")


def apply_canonical_wide(
    wide: DataFrame, scaler: DataFrame, unit: Sequence[str], columns: Mapping[str, str], *, kinds: Sequence[str] = NUMERIC, rows: int | None = None,
) -> DataFrame:
    """``apply_canonical`` on wide rows, column by column: no cells are made. ``columns``: the kind of each column."""
    scaled = [c for c, kind in columns.items() if kind in kinds]
    of = {(c, p): f"_{p}_{c}" for c in scaled for p in ("mean", "scale")}
    lookup = scaler.groupBy(*unit).agg(*[F.max(F.when(F.col("feature") == c, F.col(p))).alias(name) for (c, p), name in of.items()])
    absent = {c: F.raise_error(F.lit(f"no scaler for column {c}")).cast("double") for c in scaled}
    return wide.join(bounded(lookup, rows), list(unit), "left").withColumns({
        c: F.when(F.col(of[c, "scale"]).isNull(), absent[c]).otherwise((F.col(c) - F.col(of[c, "mean"])) / F.col(of[c, "scale"])) for c in scaled
    }).select(*wide.columns)


def invert_canonical(
    cells: DataFrame, scaler: DataFrame, unit: Sequence[str], values: Sequence[str] = ("value",), *,
    kinds: Sequence[str] = NUMERIC, rows: int | None = None,
) -> DataFrame:
    joined = _with_scaler(cells, scaler, unit, rows)
    return joined.withColumns({
        v: _scaled(F.col(v) * F.col("_scale") + F.col("_mean"), F.col(v), kinds) for v in values
    }).drop("_mean", "_scale")


# -- categorical blocks -----------------------------------------------------


def one_hot_names(codebook: Codebook, column: str) -> list[str]:
    return [f"{column}__{i}" for i in range(len(codebook[column].levels))]


def one_hot(column: str, codebook: Codebook) -> list[Column]:
    """Dummy block sized by the codebook; NULL gives NULLs, a code out of range fails."""
    size = len(codebook[column].levels)
    if size < 2:
        raise ValueError(f"nominal column {column!r} declares {size} level(s)")
    code = F.col(column)
    bad = F.raise_error(F.concat(F.lit(f"{column}: code outside the codebook: "), code.cast("string"))).cast("double")
    safe = F.when(code.isNull() | code.between(0, size - 1), code).otherwise(bad)
    return [(safe == i).cast("double").alias(name) for i, name in enumerate(one_hot_names(codebook, column))]


def invert_one_hot(columns: Sequence[str]) -> Column:
    """Index of the largest entry, the first one on a tie; all-NULL gives NULL."""
    block = F.array(*[F.col(c) for c in columns])
    return F.when(F.array_max(block).isNotNull(), F.array_position(block, F.array_max(block)) - 1).cast("double")


def unit_interval(code: Column, size: int) -> Column:
    if size < 2:
        raise ValueError(f"ordinal scale with {size} level(s)")
    return code / F.lit(float(size - 1))


def invert_unit_interval(value: Column, size: int) -> Column:
    return clip(F.rint(value * float(size - 1)), 0, size - 1)


def snap_binary(value: Column) -> Column:
    """Round half to even into {0, 1}; NULL stays NULL."""
    return clip(F.rint(value), 0, 1)


def snap_code(value: Column, size) -> Column:
    """Nearest code of 0..size-1, a tie going down; NULL stays NULL."""
    top = size - 1 if isinstance(size, Column) else F.lit(float(size - 1))
    return clip(F.ceil(value - 0.5).cast("double"), 0, top.cast("double"))


def one_hot_observed(frame: DataFrame, column: str, levels: Sequence[float]) -> DataFrame:
    """Dummies for levels found in the data, named ``<column>_<level>``; NULL stays NULL."""
    return frame.withColumns({f"{column}_{v:g}": (F.col(column) == v).cast("double") for v in levels}).drop(column)


def dense_codes(frame: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Labels to 1..K by sorted order, K being the level count."""
    levels = frame.filter(F.col(column).isNotNull()).select(column).distinct()
    numbered = levels.withColumn("_code", F.row_number().over(Window.orderBy(column)).cast("double"))
    return frame.join(bounded(numbered, rows), column, "left").drop(column).withColumnRenamed("_code", column)


# -- quantile-uniform -------------------------------------------------------


def fit_quantiles(
    cells: DataFrame, unit: Sequence[str], *, value: str = "value", knots: int = KNOTS, max_groups: int | None = None
) -> DataFrame:
    """``unit, feature, knots``: sorted array of K quantiles, K = min(knots, fewest observed cells)."""
    numeric = cells.filter(F.col("kind").isin(list(NUMERIC)) & F.col(value).isNotNull())
    counts = numeric.groupBy(*unit, "feature").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(2), F.least(F.lit(knots), F.min("_n"))).cast("int")
    sizes = counts.groupBy(*unit).agg(size.alias("_k"))
    sized = numeric.join(bounded(sizes, max_groups), list(unit))
    grid = F.transform(
        F.sequence(F.lit(0), F.col("_k") - 1), lambda i: i.cast("double") / (F.col("_k") - 1).cast("double")
    )
    found = grouped_quantiles(sized, [*unit, "feature", "_k"], value, grid, max_groups=max_groups)
    # K <= 1000 values per group, one row each: a bounded list.
    return found.groupBy(*unit, "feature").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("prob", "quantile"))), lambda s: s["quantile"]).alias("knots")
    )


def _to_uniform(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Piecewise-linear CDF; a value on a plateau of equal knots gets its middle."""
    grid = np.linspace(0.0, 1.0, len(knots))
    rising = np.interp(x, knots, grid)
    falling = np.interp(-x, -knots[::-1], -grid[::-1])
    out = 0.5 * (rising - falling)
    out = np.where(x <= knots[0], 0.0, np.where(x >= knots[-1], 1.0, out))
    return np.where(np.isnan(x), np.nan, out)


def from_uniform(p: Column, knots: Column) -> Column:
    """Inverse of the quantile transform; input clipped to [0, 1]."""
    position = clip(p, 0, 1) * (F.size(knots) - 1)
    low = F.floor(position).cast("int")
    left = F.get(knots, low)
    right = F.coalesce(F.get(knots, low + 1), left)
    return left + (right - left) * (position - low)


def apply_quantiles(
    cells: DataFrame, fitted: DataFrame, unit: Sequence[str], value: str = "value", *, rows: int
) -> DataFrame:
    """Numeric cells to [0, 1]; the others pass.

    ``rows`` bounds the fitted table (units x columns, a knot array each). It travels
    with the function, so the cells go through in Arrow batches without a join.
    """
    table = {
        tuple(r[k] for k in (*unit, "feature")): np.asarray(r["knots"], dtype=float)
        for r in pinned(fitted.select(*unit, "feature", "knots"), rows).collect()
    }
    keys = [*unit, "feature"]

    @F.pandas_udf("double")
    def uniform(x: pd.Series, which: pd.DataFrame) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        for key, part in x.groupby([which[k] for k in which.columns], sort=False):
            knots = table.get(key if isinstance(key, tuple) else (key,))
            if knots is not None:
                out.loc[part.index] = _to_uniform(part.to_numpy(dtype=float), knots)
        return out

    moved = F.nanvl(uniform(F.col(value), F.struct(*keys)), F.lit(None).cast("double"))
    return cells.withColumn(value, F.when(F.col("kind").isin(list(NUMERIC)), moved).otherwise(F.col(value)))


def invert_quantiles(
    cells: DataFrame, fitted: DataFrame, unit: Sequence[str], value: str = "value", *, rows: int | None = None
) -> DataFrame:
    """Numeric cells back from [0, 1] through the knots."""
    joined = cells.join(bounded(fitted, rows), [*unit, "feature"], "left")
    moved = from_uniform(F.col(value), F.col("knots"))
    return joined.withColumn(value, F.when(F.col("kind").isin(list(NUMERIC)), moved).otherwise(F.col(value))).drop("knots")


# -- whole units ------------------------------------------------------------


def model_space(wide: DataFrame, keys: Sequence[str], codebook: Codebook) -> DataFrame:
    """Row-local part of the model encoding; numeric columns must already be uniform."""
    out: list[Column] = []
    for v in codebook.variables:
        if v.kind == "nominal":
            out += one_hot(v.name, codebook)
        elif v.kind == "ordinal":
            out.append(unit_interval(F.col(v.name), len(v.levels)).alias(v.name))
        else:
            out.append(F.col(v.name))
    return wide.select(*keys, *out)


def from_model_space(encoded: DataFrame, keys: Sequence[str], codebook: Codebook) -> DataFrame:
    """Nearest valid categorical values; numeric columns stay uniform."""
    out: list[Column] = []
    for v in codebook.variables:
        if v.kind == "nominal":
            out.append(invert_one_hot(one_hot_names(codebook, v.name)).alias(v.name))
        elif v.kind == "ordinal":
            out.append(invert_unit_interval(F.col(v.name), len(v.levels)).alias(v.name))
        elif v.kind == "binary":
            out.append(snap_binary(F.col(v.name)).alias(v.name))
        else:
            out.append(F.col(v.name))
    return encoded.select(*keys, *out)


def prepare_units(masked: DataFrame, unit: Sequence[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scaler fitted on ``masked`` only, applied to ``masked`` and ``truth`` alike.

    Returns ``(cells in canonical space, scaler)``.
    """
    scaler = fit_canonical(masked, unit, value="masked")
    return apply_canonical(masked, scaler, unit, ["truth", "masked"], rows=rows), scaler
