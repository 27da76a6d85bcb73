"""The arms of a study by name, and their parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.frames import bounded, cut_lineage, handed_over, pinned, to_cells, union_all
from lacuna.operators import chained, impute, knn
from lacuna.plans.schema import Study

# An arm: (wide frame, unit columns, study, seed, parameters) -> cells with ``imputed``.
Arm = Callable[[DataFrame, Sequence[str], Study, int, Mapping], DataFrame]

DEFAULTS: dict[str, dict] = {
    "baseline": {},
    "mean": {},
    "knn": {"k": 3, "weights": "uniform"},
    "mice": {"max_iter": 5},
    "missranger": {"n_trees": 100, "max_iter": 10, "pmm_k": 3},
}
MAX_UNITS = 1000


def method_params(method: str, overrides: Mapping[str, Mapping] | None = None) -> dict:
    """Defaults of a method with a study's overrides on top."""
    if method not in DEFAULTS:
        raise KeyError(f"unknown method {method!r}")
    return {**DEFAULTS[method], **dict((overrides or {}).get(method, {}))}


def _cells(wide: DataFrame, unit: Sequence[str], study: Study) -> DataFrame:
    return to_cells(wide, [*unit, study.id_column], study.codebook.kinds, "masked")


def _baseline(wide, unit, study, seed, params) -> DataFrame:
    return impute.passthrough(_cells(wide, unit, study))


def _mean(wide, unit, study, seed, params) -> DataFrame:
    rows = MAX_UNITS * len(study.codebook.variables)
    return impute.impute_mean_mode(_cells(wide, unit, study), study.codebook, rows=rows, unit=unit)


def _knn(wide, unit, study, seed, params) -> DataFrame:
    """Rows are joined, not cells; the filled rows are written once and become cells when they are read."""
    names, keys = study.codebook.names, [*unit, study.id_column]
    near = knn.near_means(wide, unit, study.id_column, names, max_units=MAX_UNITS, **params)
    # A cell comes once for each open cell of its key.
    times = wide.groupBy(*keys).agg(F.array(*[F.count_if(F.col(c).isNull()) for c in names]).alias("_times"))
    means = bounded(knn.column_means(wide, unit, names), MAX_UNITS)
    joined = wide.join(near, keys, "left").join(times, keys, "left").join(means, list(unit), "left")
    filled = {c: F.coalesce(F.col(c), F.when(F.col("_times").isNotNull(), F.coalesce(F.get("_near", F.lit(j)), F.get("_means", F.lit(j))))) for j, c in enumerate(names)}
    rows = handed_over(joined.select(*keys, *names, "_times", *[x.alias(f"_filled_{c}") for c, x in filled.items()]), "knn")
    args = [x for j, (c, kind) in enumerate(study.codebook.kinds.items()) for x in (
        F.lit(c), F.lit(kind), F.col(c).cast("double"), F.col(f"_filled_{c}").cast("double"), F.greatest(F.coalesce(F.get("_times", F.lit(j)), F.lit(1)), F.lit(1)))]
    cells = rows.select(*keys, F.stack(F.lit(len(names)), *args).alias("feature", "kind", "masked", "imputed", "_n"))
    return cells.select(*keys, "feature", "kind", "masked", "imputed", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("col")


def _per_unit(run) -> Arm:
    """A model belongs to one unit, so the units take turns; each is a distributed job."""

    def arm(wide, unit, study, seed, params) -> DataFrame:
        settings = chained.ChainSettings(**params)
        parts = []
        for row in pinned(wide.select(*unit).distinct(), MAX_UNITS).collect():
            one = wide
            for u in unit:
                one = one.filter(F.col(u) == row[u])
            state, _ = run(one, study.id_column, study.codebook.names, study.codebook, settings=settings, seed=seed)
            filled = to_cells(state, [study.id_column], study.codebook.kinds, "imputed").drop("kind")
            parts.append(_cells(one, unit, study).join(filled, [study.id_column, "feature"]))
        return union_all(parts)

    return arm


ARMS: dict[str, Arm] = {
    "baseline": _baseline, "mean": _mean, "knn": _knn,
    "mice": _per_unit(chained.mice), "missranger": _per_unit(chained.missranger),
}


def impute_arm(
    wide: DataFrame, unit: Sequence[str], study: Study, method: str, *, k: int | None = None,
    overrides: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Run one method on every unit of the canonical wide frame.

    Seeds 0..k-1 are combined by the mixed vote; deterministic methods run once. The
    result is snapped to valid values and holds ``unit, id, feature, kind, masked, imputed``.
    """
    params = method_params(method, overrides)
    arm = ARMS[method]
    if method == "baseline":
        return arm(wide, unit, study, 0, params)
    members = k if k is not None and method not in impute.DETERMINISTIC else impute.ensemble_size(method)
    keys = [*unit, study.id_column, "feature", "kind", "masked"]
    out = impute.ensemble(lambda seed: arm(wide, unit, study, seed, params), members, keys)
    if members > 1 or method not in impute.DETERMINISTIC:
        out = cut_lineage(out)  # snapping and scoring read the filled cells several times; the arm runs once
    rows = MAX_UNITS * len(study.codebook.variables)
    return impute.snap_cells(out, study.codebook, rows=rows, unit=unit)
