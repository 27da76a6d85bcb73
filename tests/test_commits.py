"""The commit log of a study: crashes are repaired, tables that changed are refused."""

import pytest
from pyspark.sql import functions as F

from catalog import base
from catalog.base import STUDY
from lacuna.plans import fidelity_run
from lacuna.sources.commits import CommitLog


def test_only_committed_units_count(spark, tmp_path):
    log, path = CommitLog(spark, str(tmp_path)), str(tmp_path / "t")
    frame = spark.createDataFrame([("A", 0.05, i, None if i % 3 else float(i)) for i in range(20)] + [("B", 0.2, i, 1.0) for i in range(5)], "cohort string, alpha double, id int, x double")
    frame.filter("cohort = 'A'").write.partitionBy("cohort", "alpha").parquet(path)  # a crash: no commit
    keys = ["cohort", "alpha"]
    assert log.pending("t", frame.select(*keys).distinct(), keys).count() == 2
    table = log.table("t", path, lambda: frame, keys, seeds=[1, 2])
    assert table.count() == 25 and log.pending("t", frame.select(*keys).distinct(), keys).count() == 0
    assert log.table("t", path, lambda: 1 / 0, keys, seeds=[1]).count() == 25
    assert log.commits("t").agg(F.sum("n_rows"), F.sum("n_null")).first()[:] == (25, 13)
    with pytest.raises(ValueError, match="a seed is missing"):
        log.table("t", path, lambda: frame, keys, seeds=[1, 3])


@pytest.mark.parametrize("change, problem", [
    (lambda f: f.filter("id <> 3"), "other number of rows"), (lambda f: f.withColumn("x", F.col("x") + 1), "other content"),
    (lambda f: f.withColumn("x", F.col("x").cast("string")), "other columns"), (lambda f: f.filter("cohort = 'A'"), "gone")])
def test_what_changed_is_refused(spark, tmp_path, change, problem):
    log, path = CommitLog(spark, str(tmp_path)), str(tmp_path / "t")
    frame = spark.createDataFrame([("A", i, 2.0) for i in range(9)] + [("B", i, 1.0) for i in range(5)], "cohort string, id int, x double")
    log.table("t", path, lambda: frame, ["cohort"])
    change(frame).write.mode("overwrite").partitionBy("cohort").parquet(path)
    with pytest.raises(ValueError, match=problem):
        log.table("t", path, lambda: frame, ["cohort"])


def test_a_crash_between_two_arms_is_repaired(spark, sf, tmp_path, monkeypatch):
    study = STUDY.with_masks(designs=("mcar",), alphas=(0.2,))
    frame = base.encoded(spark, sf)
    whole = {tuple(r) for r in fidelity_run.run_fidelity(frame, study, ["mean", "knn"], str(tmp_path / "whole")).collect()}
    score, calls = fidelity_run.fid.fidelity, []

    def crash(hidden):
        calls.append(hidden)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return score(hidden)

    monkeypatch.setattr(fidelity_run.fid, "fidelity", crash)
    folder = str(tmp_path / "crashed")
    with pytest.raises(RuntimeError, match="lost"):
        fidelity_run.run_fidelity(frame, study, ["mean", "knn"], folder)
    again = fidelity_run.run_fidelity(frame, study, ["mean", "knn"], folder)
    assert {tuple(r) for r in again.collect()} == whole and len(calls) == 3  # the first arm is not scored again
