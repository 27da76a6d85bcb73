"""Cases that once went wrong: stacked units, empty columns, colliding evidence, factors as predictors."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators import chained, fidelity, mask, predict, profile
from lacuna.operators import harmonise as h
from lacuna.plans.schema import Codebook, MaskSettings, Variable
from lacuna.sources import files


def test_binary_coding_is_told_for_each_unit(spark):
    frame = spark.createDataFrame([("u1", 1.0), ("u1", 2.0), ("u2", 0.0), ("u2", 1.0), ("u3", None)], "u string, x double")
    found = sorted(h.as_binary(frame, ["x"], ["u"]).collect(), key=lambda r: (r["u"], r["x"] or 0))
    assert [(r["u"], r["x"]) for r in found] == [("u1", 0.0), ("u1", 1.0), ("u2", 0.0), ("u2", 1.0), ("u3", None)]


def test_model_matrix_of_stacked_units_and_without_numbers(spark):
    frame = spark.createDataFrame([("u1", "train", 1.0), ("u1", "test", 2.0), ("u2", "train", 0.0), ("u2", "test", 1.0)], "u string, fold string, b double")
    book = Codebook((Variable("b", "binary", ("No", "Yes")),))
    found = predict.model_matrix(frame, ["u"], ["fold"], book, max_units=2).collect()
    assert sorted((r["u"], r["fold"], r["b"]) for r in found) == [("u1", "test", 1.0), ("u1", "train", 0.0), ("u2", "test", 1.0), ("u2", "train", 0.0)]


def test_empty_columns_keep_a_type(spark):
    frame = spark.createDataFrame([(1.5, None, None), (2.5, None, None), (3.5, None, None)], "x double, none double, gone string")
    kinds = {r["feature"]: r["type"] for r in profile.feature_meta(frame, ["x", "none", "gone"]).collect()}
    assert kinds == {"x": "continuous", "none": "multiclass", "gone": "multiclass"}
    book = profile.build_codebook(frame, ["x", "none", "gone"], profile.DeclaredTypes())
    assert {v.name: (v.kind, v.levels) for v in book.variables} == {"x": ("continuous", ()), "none": ("continuous", ()), "gone": ("nominal", ())}


def test_all_problems_of_a_codebook_are_reported(spark):
    columns = [f"c{k:03d}" for k in range(130)]
    frame = spark.createDataFrame([tuple(f"{k}-{c}" for c in columns) for k in range(40)], ", ".join(f"{c} string" for c in columns))
    with pytest.raises(ValueError) as error:
        profile.build_codebook(frame, columns, profile.DeclaredTypes())
    assert all(c in str(error.value) for c in columns)


@pytest.mark.parametrize(("one", "other"), [(("a|b", "c"), ("a", "b|c")), ((None, "x"), ("~", "x")), (("", None), (None, ""))])
def test_fingerprints_tell_rows_apart(spark, one, other):
    found = [files.fingerprint(spark.createDataFrame([row], "x string, y string")).first()["hash_sum"] for row in (one, other)]
    assert found[0] != found[1]


def test_cohorts_have_their_own_drivers_and_coefficients(spark):
    counts = spark.createDataFrame([("A", "p", 100, 100), ("A", "q", 100, 40), ("B", "p", 100, 50), ("B", "q", 100, 99)], "cohort string, feature string, n long, n_observed long")
    settings = MaskSettings(driver_min_observed=0.9)
    assert mask.mar_drivers(counts, settings, ["p", "q"]) == {"A": ["p"], "B": ["q"]}
    assert mask.mar_betas(settings, "A", "t", ["p"]) != mask.mar_betas(settings, "B", "t", ["p"])
    rows = spark.createDataFrame([("A", 1.0, -3.0), ("B", 1.0, -3.0), ("C", 1.0, -3.0)], "cohort string, z_p double, z_q double")
    weights = {r[0]: r[1] for r in rows.select("cohort", mask.mar_weight(settings, "t", {"A": ["p"], "B": ["q"]})).collect()}
    assert weights["C"] == 1.0 and weights["A"] != weights["B"]


def test_factors_enter_as_levels_and_no_predictors_as_a_constant(spark):
    # The value depends on the level, but not in the order of its code.
    by_level = {0: 10.0, 1: -10.0, 2: 10.0, 3: -10.0}
    rows = [(i, float(i % 4), by_level[i % 4] + (i % 3) * 0.01, None if i % 10 == 0 else by_level[i % 4]) for i in range(400)]
    state = spark.createDataFrame(rows, "id long, level double, y double, obs_y double")
    book = Codebook((Variable("level", "nominal", ("a", "b", "c", "d")), Variable("y", "continuous")))
    settings = chained.ChainSettings(donors=1, ridge=1e-6)
    filled = chained.impute_column_mice(state, "y", ["level"], "id", book, settings, 1).collect()
    assert len(filled) == 40 and all(r["imputed"] == by_level[r["id"] % 4] for r in filled)
    assert chained._assembled(state, ["level"], book).schema["_x"].metadata["ml_attr"]["attrs"]["nominal"][0]["vals"] == ["a", "b", "c", "d"]
    drawn = chained.impute_column_mice(state, "y", [], "id", book, settings, 1).collect()
    assert len(drawn) == 40 and {r["imputed"] for r in drawn} <= {10.0, -10.0}


def test_unscreened_columns_have_no_predictors(spark):
    frame = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("double").alias("x"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("y"))
    assert chained._predictor_lists(frame, ["x", "y"], chained.ChainSettings()) == {"x": [], "y": []}


def test_bootstrap_weights_reach_their_mean(spark):
    cells = spark.range(3000).select(
        F.col("id").cast("string").alias("recordid"), F.lit("f").alias("feature"), F.lit("continuous").alias("kind"), F.lit("A").alias("cohort"), F.lit("mcar").alias("design"),
        F.lit(0.1).alias("alpha"), F.lit("m").alias("method"), F.lit(2).alias("status"), (F.col("id") % 7).cast("double").alias("truth"), F.lit(0.0).alias("imputed"))
    found = fidelity.bootstrap(cells, "recordid", resamples=20, fraction=12.0).agg(F.avg("value")).first()[0]
    assert abs(found - (sum(k * k for k in range(7)) / 7) ** 0.5) < 0.02


def test_only_open_cells_are_combined(spark):
    from lacuna.operators import impute

    schema = "rid string, feature string, kind string, masked double, imputed double"
    first = [("r", "c", "nominal", None, 2.0), ("r", "d", "binary", 1.0, 1.0), ("r", "e", "continuous", None, 1.0), ("s", "e", "continuous", 0.1, 0.1)]
    second = [("r", "c", "nominal", None, 1.0), ("r", "d", "binary", 1.0, 1.0), ("r", "e", "continuous", None, 4.0), ("s", "e", "continuous", 0.1, 0.1)]
    frames = [spark.createDataFrame(rows, schema) for rows in (first, second)]
    out = impute.ensemble(lambda seed: frames[seed], 2, ["rid", "feature"])
    assert {(r["rid"], r["feature"]): r["imputed"] for r in out.collect()} == {("r", "c"): 1.0, ("r", "d"): 1.0, ("r", "e"): 2.5, ("s", "e"): 0.1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnull(masked") == 2 and plan.count("isnotnull(masked") == 1  # observed cells do not go through the aggregate


def test_driver_scores_are_the_same_in_every_job(spark):
    rows = [(c, k * 0.1) for c in ("A", "B") for k in range(50)]
    scored = mask.driver_scores(spark.createDataFrame(rows, "cohort string, a double"), ["a"], 2)
    assert "Aggregate" not in scored._jdf.queryExecution().optimizedPlan().toString()  # sums of doubles depend on their order
    assert scored.agg({"z_a": "stddev_pop"}).first()[0] == pytest.approx(1.0)
