"""Invariants of masks, imputers, encodings and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import base
from catalog.base import CODEBOOK, KEYS, STUDY
from catalog.flagship import canonical_cells, masked_cells
from catalog.neighbours import canonical_wide
from catalog.outcomes import binary_folds
from lacuna.functions.frames import to_cells
from lacuna.operators import chained, encode, fidelity, harmonise, impute, knn, mask, profile
from lacuna.plans import arms
from lacuna.plans.schema import Codebook, Variable

CELL = [*KEYS, "feature", "design"]


def test_masks_nest_and_status_agrees_with_values(spark, sf):
    cells = masked_cells(spark, sf)
    small = cells.filter("alpha = 0.05 and status = 2").select(*CELL)
    large = cells.filter("alpha = 0.2 and status = 2").select(*CELL)
    assert small.count() > 0
    assert small.join(large, CELL, "left_anti").count() == 0
    assert cells.filter("status = 0 and masked is null").count() == 0
    assert cells.filter("status <> 0 and masked is not null").count() == 0
    assert cells.filter("status = 2 and truth is null").count() == 0
    assert cells.filter("status = 1 and truth is not null").count() == 0


def test_masks_do_not_depend_on_partitioning(spark, sf):
    frame = base.encoded(spark, sf)
    study = STUDY.with_masks(designs=("mcar", "mar", "mnar"), driver_min_observed=0.94)
    found = []
    for n in (1, 13):
        hidden = mask.inject(frame.repartition(n), study).filter("status = 2").select(*CELL, "alpha")
        found.append({tuple(r) for r in hidden.collect()})
    assert found[0] == found[1] and {d for *_, d, _ in found[0]} == {"mcar", "mar", "mnar"}


def test_degenerate_tails_fall_back_to_rare_levels(spark):
    # One value holds most cells and the rest are all distinct: the tails cover everything.
    rows = [("A", str(i), 0.0 if i % 3 else float(i), None if i % 10 == 0 else float(i % 2)) for i in range(900)]
    frame = spark.createDataFrame(rows, "cohort string, recordid string, amount double, flag double")
    frame = frame.withColumn("amount", F.when(F.col("recordid").cast("int") % 7 != 0, F.col("amount")))
    book = Codebook((Variable("amount", "continuous"), Variable("flag", "binary", ("No", "Yes"))))
    study = base.Study(book, ("A",), base.MaskSettings(designs=("mnar",)))
    levels = mask.level_counts(to_cells(frame, KEYS, book.kinds))
    rules = {r["feature"]: r["branch"] for r in mask.tail_profile(levels, study).collect()}
    assert rules == {"amount": "rare_wide", "flag": "rare"}
    cells = mask.weighted_cells(frame, study, book.names).filter("value is not null and feature = 'amount'")
    rare = cells.filter("weight = 3.0").select("value").distinct().count()
    assert rare == cells.select("value").distinct().count() // 2
    assert mask.inject(frame, study).filter("status = 2").count() > 0


@pytest.mark.parametrize("method", ["mean", "knn"])
def test_imputers_complete_the_matrix_and_keep_observed_cells(spark, sf, method):
    out = arms.impute_arm(canonical_wide(spark, sf), ["cohort"], STUDY, method)
    assert out.filter("imputed is null").count() == 0
    assert out.filter("masked is not null and masked <> imputed").count() == 0
    assert out.count() == canonical_wide(spark, sf).count() * len(CODEBOOK.names)


def test_baseline_arm_is_the_masked_matrix(spark, sf):
    out = arms.impute_arm(canonical_wide(spark, sf), ["cohort"], STUDY, "baseline")
    assert out.filter("not (masked <=> imputed)").count() == 0


def _brute_force(x, k):
    n, p = x.shape
    out = {}
    means = np.nanmean(x, axis=0)
    for i in range(n):
        for j in np.flatnonzero(np.isnan(x[i])):
            ranked = []
            for d in range(n):
                both = ~np.isnan(x[i]) & ~np.isnan(x[d])
                if d != i and both.any() and not np.isnan(x[d, j]):
                    ranked.append((round(float(np.sqrt(p / both.sum() * ((x[i] - x[d])[both] ** 2).sum())), 9), d))
            near = sorted(ranked)[:k]
            out[(i, j)] = np.mean([x[d, j] for _, d in near]) if near else means[j]
    return out


@pytest.mark.parametrize("complete, block_rows", [(2, 20), (0, 15), (1, 1000)])
def test_knn_equals_brute_force(spark, complete, block_rows):
    rng = np.random.default_rng(complete)
    x = np.round(rng.normal(size=(120, 6)), 1)
    x[:40, 0] = 0.0  # a third of the rows share their projection
    gaps = rng.random(x.shape) < 0.2
    gaps[:, :complete] = False
    x[gaps] = np.nan
    names = [f"f{j}" for j in range(6)]
    rows = [("u", i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    frame = spark.createDataFrame(rows, "unit string, rid long, " + ", ".join(f"{c} double" for c in names))
    out = knn.impute_knn(frame, ["unit"], "rid", names, block_rows=block_rows, max_units=1).collect()
    want = _brute_force(x, 3)
    assert len(out) == len(want)
    for r in out:
        assert r["imputed"] == pytest.approx(want[(r["rid"], names.index(r["feature"]))]), r


def test_mean_matching_equals_brute_force_and_returns_observed_values(spark):
    rng = np.random.default_rng(1)
    pred = np.round(rng.normal(size=300), 1)  # many equal predictions
    pred[:100] = 0.5
    rows = [(str(i), None if i % 4 == 0 else float(i), float(pred[i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "rid string, observed double, prediction double")
    out = {r["rid"]: r["imputed"] for r in chained.match_means(frame, "rid", k=3, seed=0, label="c").collect()}
    donors = [(float(pred[i]), str(i), float(i)) for i in range(300) if i % 4]
    assert len(out) == 75
    for i in range(0, 300, 4):
        near = sorted((round(abs(p - pred[i]), 9), p, rid, v) for p, rid, v in donors)[:3]
        assert out[str(i)] in {v for *_, v in near}


def test_class_draw_follows_the_cumulative_sum(spark):
    frame = spark.createDataFrame([([0.2, 0.0, 0.8], u) for u in (0.1, 0.19, 0.21, 0.99)], "p array<double>, u double")
    got = [r[0] for r in frame.select(chained.draw_class(F.col("p"), F.col("u"))).collect()]
    assert got == [0.0, 0.0, 2.0, 2.0]


def test_vote_takes_the_majority_and_the_lowest_on_a_tie(spark):
    rows = [("r", "c", "nominal", v) for v in (2.0, 1.0, 2.0)] + [("r", "d", "binary", v) for v in (1.0, 0.0)] + [
        ("r", "e", "continuous", v) for v in (1.0, 4.0)]
    frame = spark.createDataFrame(rows, "rid string, feature string, kind string, imputed double")
    got = {r["feature"]: r["imputed"] for r in impute.combine_members(frame, ["rid", "feature"], mode="mixed_vote").collect()}
    assert got == {"c": 2.0, "d": 0.0, "e": 2.5}
    with pytest.raises(ValueError):
        impute.combine_members(frame, ["rid", "feature"], mode="median")


def test_residual_guard_rejects_an_empty_column(spark):
    frame = spark.createDataFrame([("A", "m", 0.1, "f", "continuous", None)], "cohort string, design string, alpha double, feature string, kind string, imputed double")
    with pytest.raises(ValueError, match="entirely missing"):
        impute.fill_residual(frame, rows=10)


def test_encode_decode_round_trip_and_errors(spark, sf):
    registry = base.registry(spark, sf)
    coded = profile.encode(registry, CODEBOOK, KEYS)
    back = profile.decode(coded, CODEBOOK, KEYS)
    names = ["nom_segment", "ord_priority", "bin_lowbal"]
    assert back.select(*KEYS, *names).exceptAll(registry.select(*KEYS, *names)).count() == 0
    drifted = registry.withColumn("nom_segment", F.lit("SPACECRAFT"))
    with pytest.raises(Exception, match="not in the codebook"):
        profile.encode(drifted, CODEBOOK, KEYS).write.format("noop").mode("overwrite").save()
    outside = coded.withColumn("nom_segment", F.lit(9.0))
    with pytest.raises(Exception, match="outside the codebook"):
        outside.select(*encode.one_hot("nom_segment", CODEBOOK)).write.format("noop").mode("overwrite").save()


def test_codebook_reports_all_problems_at_once(spark, sf):
    frame = base.registry(spark, sf).withColumn("free", F.col("recordid"))
    declared = profile.DeclaredTypes(ordinal={"ord_priority": base.PRIORITIES[1:]})
    with pytest.raises(ValueError, match="free(.|\n)*ord_priority"):
        profile.build_codebook(frame, ["free", "ord_priority", "bin_lowbal"], declared)
    book = profile.build_codebook(
        frame, ["cont_price", "cnt_lines", "bin_lowbal", "ord_priority"],
        profile.DeclaredTypes(ordinal={"ord_priority": base.PRIORITIES}, count=["cnt_lines"]),
    )
    assert book.kinds == {"cont_price": "continuous", "cnt_lines": "count", "bin_lowbal": "binary", "ord_priority": "ordinal"}
    assert book["ord_priority"].levels == tuple(base.PRIORITIES) and book["bin_lowbal"].levels == ("No", "Yes")


def test_a_column_plan_gives_every_column_a_role(spark):
    table = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.2), ("t", 0.0), ("x", 0.9)], "feature string, miss_max double")
    with pytest.raises(ValueError, match="ties"):
        profile.column_plan(table, n_predictors=2, always_drop=["x"], held_out=["t"])
    with pytest.raises(ValueError, match="available"):
        profile.column_plan(table, n_predictors=4, always_drop=["x"], held_out=["t"])
    plan = profile.column_plan(table, n_predictors=1, always_keep=["id"], always_drop=["x"], held_out=["t"])
    found = {r["feature"]: (r["role"], r["miss_max"], r["next_excluded"]) for r in plan.collect()}
    assert found == {
        "id": ("kept", None, None), "x": ("dropped", 0.9, None), "t": ("held_out", 0.0, None),
        "a": ("predictor", 0.1, False), "b": ("excluded", 0.2, True), "c": ("excluded", 0.2, True)}
    assert profile.planned_columns(plan) == ["id", "a"]
    summary = {r["role"]: (r["n"], r["least"], r["most"]) for r in profile.plan_summary(plan).collect()}
    assert summary["excluded"] == (2, 0.2, 0.2) and summary["predictor"] == (1, 0.1, 0.1)
    assert profile.planned_columns(profile.column_plan(table, max_missing_fraction=0.2)) == ["a", "b", "c", "t"]


def test_degenerate_scales_are_flagged(spark):
    rows = [("A", "flat", "continuous", 5.0), ("A", "flat", "continuous", 5.0), ("A", "gone", "continuous", None)]
    cells = spark.createDataFrame(rows, "cohort string, feature string, kind string, value double")
    got = {r["feature"]: r for r in encode.fit_canonical(cells, ["cohort"]).collect()}
    assert (got["flat"]["mean"], got["flat"]["scale"], got["flat"]["degenerate"]) == (5.0, 1.0, True)
    assert (got["gone"]["mean"], got["gone"]["scale"], got["gone"]["degenerate"]) == (0.0, 1.0, True)


def test_names_aliases_and_keys_fail_loudly(spark):
    frame = spark.createDataFrame([(1, 2)], "`losas (days)` int, `Or Time` int")
    assert harmonise.normalise_column_names(frame).columns == ["losas_days", "or_time"]
    with pytest.raises(ValueError):
        harmonise.normalise_column_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    with pytest.raises(KeyError):
        harmonise.apply_column_aliases(frame, {"nope": "x"})
    with pytest.raises(ValueError):
        harmonise.apply_column_aliases(frame, {"Or Time": "losas (days)"})
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id int, v int")
    once = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="not unique"):
        harmonise.align_on_id(once, twice, ["v"], "id")
    with pytest.raises(ValueError, match="held-out"):
        harmonise.join_targets(twice, twice, ["id"])
    with pytest.raises(TypeError):
        harmonise.structural_rules(twice, [{"name": "r", "categorical": ["v"], "when": {"id": [1]}}])


def test_ladder_keeps_interior_gaps(spark):
    rows = [("a", None, "c", None), (None, None, None, None), ("a", "b", "c", "d")]
    frame = spark.createDataFrame(rows, "s01 string, s02 string, s03 string, s04 string")
    for rule in harmonise.ladder_rules(frame, ["s"], ["01", "02", "03", "04"], "NA"):
        frame = rule.apply(frame)
    assert [tuple(r) for r in frame.collect()] == [("a", None, "c", "NA"), ("NA",) * 4, ("a", "b", "c", "d")]


def test_splits_are_disjoint_exhaustive_and_proportional(spark, sf):
    folds = binary_folds(spark, sf)
    per_row = folds.groupBy("cohort", "recordid", "seed").count()
    assert per_row.filter("count <> 1").count() == 0
    n = folds.filter("seed = 42").count()
    shares = {r["fold"]: r["count"] / n for r in folds.filter("seed = 42").groupBy("fold").count().collect()}
    assert shares == pytest.approx({"train": 0.6, "val": 0.2, "test": 0.2}, abs=0.01)
    by_class = folds.filter("seed = 42 and cohort = 'A'").groupBy("fold").agg(F.avg("y")).collect()
    assert max(r[1] for r in by_class) - min(r[1] for r in by_class) < 0.01


def test_scores_ignore_cells_left_open(spark):
    rows = [("f", "nominal", 2, 1.0, 1.0), ("f", "nominal", 2, 0.0, None), ("f", "nominal", 2, 2.0, 1.0), ("f", "nominal", 0, 2.0, 0.0)]
    cells = spark.createDataFrame(rows, "feature string, kind string, status int, truth double, imputed double").withColumn("method", F.lit("m"))
    got = fidelity.categorical_metrics(fidelity.confusion(cells, ["method"]), ["method"]).first()
    assert got["accuracy"] == pytest.approx(0.5)
    assert got["balanced_acc"] == pytest.approx(0.5)
    assert got["f1_macro"] == pytest.approx((2 / 3 + 0) / 2)


def test_canonical_space_inverts(spark, sf):
    cells = canonical_cells(spark, sf).filter("kind = 'continuous' and status = 0")
    stats = cells.groupBy("cohort", "design", "alpha", "feature").agg(F.avg("masked").alias("m"), F.stddev_pop("masked").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in stats)


def test_a_study_runs_and_resumes(spark, sf, tmp_path):
    from lacuna.plans.fidelity_run import run_fidelity

    study = STUDY.with_masks(designs=("mcar",), alphas=(0.2,))
    frame = base.encoded(spark, sf)
    first = run_fidelity(frame, study, ["mean"], str(tmp_path / "study"))
    mean = {tuple(r) for r in first.collect()}
    both = run_fidelity(frame, study, ["mean", "knn"], str(tmp_path / "study"))
    assert {r["method"] for r in both.select("method").distinct().collect()} == {"mean", "knn"}
    assert {tuple(r) for r in both.filter("method = 'mean'").collect()} == mean
    rmse = both.filter("metric = 'rmse' and feature = 'cont_price' and method = 'mean'").agg(F.avg("value")).first()[0]
    assert 0.8 < rmse < 1.2


def test_cells_follow_every_complete_column():
    points = np.array([(a, b) for a in range(7) for b in range(5)] * 20, dtype=float)
    feature, cut, left = knn._cell_tree(points, 20)
    assert (feature < 0).sum() == 35  # points with one sum, (1, 2) and (2, 1), lie in different cells
