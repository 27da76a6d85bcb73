"""Masks as one row a record, against clocks and cut-offs made by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import base
from catalog.base import STUDY
from lacuna.functions.columns import hash_uniform_value
from lacuna.functions.ordered import grouped_quantiles
from lacuna.operators import mask
from lacuna.plans.schema import Codebook, MaskSettings, Study, Variable

BOOK = Codebook((Variable("flag", "binary", ("No", "Yes")), Variable("amount", "continuous"), Variable("whole", "continuous")))
SCHEMA = "cohort string, recordid string, flag double, amount double, whole double"


def table(n=400):
    return [("AB"[i % 2], str(i), None if i % 3 == 0 else float(i % 5 == 0), None if i % 4 == 1 else float(i * i % 97), 1.0) for i in range(n)]


def by_hand(rows, alphas):
    """(cohort, id, feature, alpha) of every cell hidden completely at random."""
    found = set()
    for cohort in "AB":
        seed = mask.unit_seed(2025, cohort, "mcar")
        own = [r for r in rows if r[0] == cohort]
        for k, feature in ((2, "flag"), (3, "amount")):
            known = [r for r in own if r[k] is not None]
            order = sorted((-math.log(hash_uniform_value(seed, feature, r[1])), r[1]) for r in known)
            for alpha in alphas:
                budget = math.floor(len(own) * alpha * ((len(own) - len(known)) / len(own)))
                found |= {(cohort, i, feature, alpha) for _, i in order[:budget]}
    return found


@pytest.mark.parametrize("alphas", [(0.2, 0.05, 0.4), (0.001, 0.3)])  # not in order; one without a budget
def test_hidden_cells_are_the_first_clocks(spark, alphas):
    rows = table()
    study = Study(BOOK, ("A", "B"), MaskSettings(designs=("mcar",), alphas=alphas))
    cells = mask.inject(spark.createDataFrame(rows, SCHEMA).repartition(5), study)
    hidden = {(r["cohort"], r["recordid"], r["feature"], r["alpha"]) for r in cells.filter("status = 2").collect()}
    assert hidden == by_hand(rows, alphas) and hidden
    assert cells.count() == len(rows) * 3 * len(alphas)
    assert cells.filter("masked is not null and status <> 0").count() == 0
    assert cells.filter("(truth is null) <> (status = 1)").count() == 0


def test_a_table_without_gaps_stays_whole(spark):
    frame = spark.createDataFrame([("A", str(i), 1.0, float(i), 2.0) for i in range(30)], SCHEMA)
    cells = mask.inject(frame, Study(BOOK, ("A", "B"), MaskSettings()))
    assert cells.count() == 30 * 3 * 4 and cells.filter("status <> 0 or masked is null").count() == 0


def test_masks_are_handed_over_as_records(spark, sf):
    frame = base.encoded(spark, sf)
    assert mask.hidden(frame, STUDY).count() == frame.count()  # not a row for each cell, design and intensity


def test_few_quantiles_count_values_of_their_buckets_alone(spark):
    rng = np.random.default_rng(4)
    values = {g: np.concatenate([rng.normal(0, 10.0**g, 500), np.full(300, 1.5), [-0.0, 0.0]]) for g in range(3)}
    frame = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [(0, None)], "g int, x double")
    probs = [0.0, 0.3, 0.5, 0.7, 1.0]
    found = grouped_quantiles(frame, ["g"], "x", probs, max_groups=3)
    got = {(r["g"], r["prob"]): r["quantile"] for r in found.collect()}
    assert got == {(g, p): pytest.approx(float(np.quantile(v, p)), abs=1e-12) for g, v in values.items() for p in probs}
    counted = frame.groupBy("g", F.col("x")).agg(F.count(F.lit(1)).alias("n"))
    weighted = grouped_quantiles(counted, ["g"], "x", probs, weight="n", max_groups=3)
    assert {(r["g"], r["prob"]): r["quantile"] for r in weighted.collect()} == got
