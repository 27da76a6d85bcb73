"""The model queries cover every cohort and seed with the declared grids, in one fit each."""

import pytest

from catalog import models
from catalog.base import COHORTS
from lacuna.operators import predict as pr


@pytest.mark.parametrize("name", ["binary_model", "downsampled_model", "continuous_model", "hurdle_model", "log_error_model"])
def test_model_queries_run_whole_units(spark, sf, monkeypatch, name):
    people = spark.createDataFrame([(c, str(k), k, float(k), k % 2) for c in COHORTS for k in range(10)], "cohort string, recordid string, cnt_lines long, y_cont double, y_bin int")
    calls = []

    def predict_units(frame, unit, id_column, target, codebook, *, seeds=pr.SEEDS, **options):
        calls.append(options)
        assert frame.filter(f"{target} is null").count() == 0
        assert {r["cohort"] for r in frame.select("cohort").distinct().collect()} == set(COHORTS)
        return [{"cohort": c, "seed": s} for c in COHORTS for s in seeds]

    monkeypatch.setattr(models, "people", lambda spark, sf: people)
    monkeypatch.setattr(models, "stored", lambda spark, sf, name, build: build())
    monkeypatch.setattr(models.m, "predict_units", predict_units)
    found = [(r["cohort"], r["seed"]) for r in getattr(models, name)(spark, sf).collect()]
    assert sorted(found) == sorted((c, s) for c in COHORTS for s in pr.SEEDS)
    assert len(calls) == 1 and not {"grid", "classifier", "seeds"} & set(calls[0])
