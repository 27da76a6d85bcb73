"""A whole reconstruction study: mask, prepare, impute by every arm, score, keep.

Stage outputs are tables under one folder, with the unit and the method as partition
columns. A run picks up where an earlier one stopped: only what the commit log under the
folder has counts as done, and a table that is not what was committed is refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.frames import local_frame, require_empty, to_wide
from lacuna.operators import fidelity as fid
from lacuna.operators import impute, mask
from lacuna.operators.encode import prepare_units
from lacuna.plans.arms import impute_arm
from lacuna.plans.schema import Study
from lacuna.sources.commits import CommitLog

UNIT = impute.UNIT


def run_fidelity(
    frame: DataFrame, study: Study, methods: Sequence[str], folder: str, *, k: int = 2,
    overrides: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Tidy ``cohort, design, alpha, method, metric, feature, value`` of every arm.

    ``frame`` is the wide encoded matrix. Raises when the finished grid has a hole, a
    duplicate or arms scored on different features.
    """
    spark, log = frame.sparkSession, CommitLog(frame.sparkSession, folder)
    rows = study.groups(designs=True, alphas=True)
    masked = log.table("masked", f"{folder}/masked", lambda: mask.inject(frame, study), UNIT)
    canonical = log.table("canonical", f"{folder}/canonical", lambda: prepare_units(masked, UNIT, rows)[0], UNIT)
    keys = [*UNIT, study.id_column]
    wide = log.table("matrix", f"{folder}/matrix", lambda: to_wide(canonical, keys, study.codebook.names, "masked"), UNIT)
    truth = canonical.filter("status = 2").select(*keys, "feature", "truth", "status")

    scores = f"{folder}/scores"
    wanted = local_frame(spark, [(m,) for m in methods], "method string")
    grid = masked.select(*UNIT).distinct().crossJoin(F.broadcast(wanted))
    units = ["method", *UNIT]
    open_arms = log.pending("scores", grid, units)
    for method in [r["method"] for r in open_arms.select("method").distinct().orderBy("method").collect()]:
        members = range(impute.ensemble_size(method) if method in impute.DETERMINISTIC else k)
        filled = log.table(
            f"imputed {method}", f"{folder}/imputed/method={method}", lambda m=method: impute_arm(wide, UNIT, study, m, k=k, overrides=overrides), UNIT, seeds=members
        )
        hidden = filled.join(truth, [*keys, "feature"]).withColumn("method", F.lit(method))
        log.add("scores", scores, fid.fidelity(hidden), units, F.col("method") == method)
    log.require("scores", spark.read.parquet(scores), units)
    values = spark.read.parquet(scores).select(*UNIT, "method", "metric", "feature", "value")
    values = values.withColumn("alpha", F.col("alpha").cast("double"))
    require_empty(fid.grid_violations(values, grid.withColumn("alpha", F.col("alpha").cast("double"))), "fidelity grid")
    return values
