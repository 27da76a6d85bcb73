"""Neighbours within one task: what is compared, and which rows may give a value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import knn
from lacuna.plans import arms
from lacuna.plans.schema import Codebook, Study, Variable


def test_a_task_leaves_out_what_cannot_be_near(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 4))
    x[np.arange(6000), rng.integers(1, 4, 6000)] = np.nan  # every row has a gap, none of column 0
    summed = []
    meet = knn._Nearest._meet
    monkeypatch.setattr(knn._Nearest, "_meet", lambda self, r, d: (summed.append(len(r)), meet(self, r, d))[1])
    r, f, d, gap = knn._search(x, x, 3, np.full(6000, np.inf))
    assert sum(summed) < 0.1 * 6000 * 6000
    assert len(r) == 3 * 6000
    for i in range(0, 6000, 500):
        j = int(np.flatnonzero(np.isnan(x[i]))[0])
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.round(np.sqrt(4 / both.sum(axis=1) * np.where(both, x - x[i], 0.0).__pow__(2).sum(axis=1)), 9)
        far[np.isnan(x[:, j])] = np.inf
        assert sorted(d[r == i].tolist()) == sorted(np.lexsort((np.arange(6000), far))[:3].tolist())
        assert set(f[r == i].tolist()) == {j}


def test_equal_rows_rare_columns_and_ids_with_other_rows(spark):
    # 40 equal donors give the first three ids; the id "b" has another row, which must not give to it; "rare" is known once.
    rows = [("u", f"a{k:02d}", 1.0, float(k), None) for k in range(40)] + [("u", "b", 1.0, None, None), ("u", "b", 1.0, -7.0, None), ("u", "z", 9.0, 5.0, 2.0)]
    frame = spark.createDataFrame(rows, "unit string, rid string, x double, y double, rare double")
    found = {(r["rid"], r["feature"]): r["imputed"] for r in knn.impute_knn(frame, ["unit"], "rid", ["x", "y", "rare"], max_units=1).collect()}
    assert found[("b", "y")] == pytest.approx(1.0)  # of a00, a01, a02, not of the other row of b
    assert {v for (_, f), v in found.items() if f == "rare"} == {2.0}


def test_filled_rows_become_cells_without_a_join_of_cells(spark, monkeypatch):
    study = Study(Codebook((Variable("x", "continuous"), Variable("y", "continuous"))), ("A",))
    frame = spark.createDataFrame([("A", str(k), float(k), None if k % 3 == 0 else float(k)) for k in range(30)], "cohort string, recordid string, x double, y double")
    monkeypatch.setattr(arms, "cut_lineage", lambda frame: pytest.fail("the cells of one member need no copy"))
    out = arms.impute_arm(frame, ["cohort"], study, "knn")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.agg(F.count("imputed")).first()[0] == 60
