"""Tail probabilities and paired tests against hand-made values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions.tails import chi2_sf, signed_rank_p
from lacuna.operators import stats


@pytest.mark.parametrize("df, critical", [(1, 3.841459), (2, 5.991465), (3, 7.814728), (6, 12.591587), (7, 14.067140), (8, 15.507313)])
def test_chi2_tail_at_the_five_percent_points(df, critical):
    assert chi2_sf(critical, df) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(0.0, df) == pytest.approx(1.0)
    assert chi2_sf(None, df) is None


@pytest.mark.parametrize("n", [3, 5, 8])
def test_exact_signed_rank_matches_enumeration(n):
    ranks = np.arange(1, n + 1)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in range(0, n * (n + 1) // 4 + 1):
        below = sum(s <= w for s in sums) / len(sums)
        assert signed_rank_p(w, n, 0.0, 0) == pytest.approx(min(1.0, 2 * below))


def test_signed_rank_normal_form_is_used_for_ties_and_zeros():
    n, w = 20, 50.0
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    expected = math.erfc(abs(w - n * (n + 1) / 4.0) / spread / math.sqrt(2))
    assert signed_rank_p(w, n, 0.0, 1) == pytest.approx(expected)
    assert signed_rank_p(None, 0, 0.0, 0) is None


def _scores(spark, rng):
    rows = [
        (fam, b, arm, float(rng.integers(0, 6)) + (0.5 if arm == "c" else 0.0))
        for fam in ("x", "y") for b in range(12) for arm in ("a", "b", "c")
    ]
    return spark.createDataFrame(rows, "family string, block int, arm string, value double")


def test_friedman_and_ranks_against_numpy(spark):
    scores = _scores(spark, np.random.default_rng(3))
    complete = stats.paired_blocks(scores, ["family"], ["block"], ["a", "b", "c"])
    ranks = stats.block_ranks(complete, ["family", "block"], stats.LOWER)
    k = 3
    total = ranks.groupBy("family").sum("rank").collect()
    assert all(r[1] == 12 * k * (k + 1) / 2 for r in total)
    got = {r["family"]: r for r in stats.friedman(stats.arm_summary(ranks, ["family"]), ["family"], stats.LOWER).collect()}
    wide = scores.toPandas().pivot_table(index=["family", "block"], columns="arm", values="value")
    for family in ("x", "y"):
        r = wide.loc[family].rank(axis=1)
        n = len(r)
        ties = sum((c**3 - c) for row in wide.loc[family].to_numpy() for c in pd.Series(row).value_counts())
        raw = 12 / (n * k * (k + 1)) * (r.sum() ** 2).sum() - 3 * n * (k + 1)
        assert got[family]["chi2"] == pytest.approx(raw / (1 - ties / (n * k * (k * k - 1))))
        assert got[family]["mean_ranks"] == pytest.approx(r.mean().to_dict())
        med = wide.loc[family].median()
        assert got[family]["spread_pct"] == pytest.approx((med.max() - med.min()) / med.abs().median() * 100)


def test_incomplete_blocks_drop_out_and_are_counted(spark):
    rows = [("x", b, arm, 1.0 * b) for b in range(4) for arm in ("a", "b") if not (b == 2 and arm == "b")]
    scores = spark.createDataFrame(rows, "family string, block int, arm string, value double")
    out = stats.paired_blocks(scores, ["family"], ["block"], ["a", "b"])
    assert {r["block"] for r in out.collect()} == {0, 1, 3}
    assert {r["n_blocks_total"] for r in out.collect()} == {4}


def test_holm_is_monotone_and_passes_nulls(spark):
    raw = [0.01, 0.04, 0.03, 0.005, None]
    frame = spark.createDataFrame([("f", i, p) for i, p in enumerate(raw)], "family string, i int, p_value double")
    got = {r["i"]: r["p_holm"] for r in stats.holm(frame, ["family"]).collect()}
    assert got[4] is None
    assert [got[i] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_pairwise_statistics_against_pandas(spark):
    scores = _scores(spark, np.random.default_rng(5))
    complete = stats.paired_blocks(scores, ["family"], ["block"], ["a", "b", "c"])
    rows = stats.pairwise_wilcoxon(complete, ["family"], ["block"], stats.LOWER).collect()
    wide = scores.toPandas().pivot_table(index=["family", "block"], columns="arm", values="value")
    assert len(rows) == 6
    for r in rows:
        d = wide.loc[r["family"]][r["arm_a"]] - wide.loc[r["family"]][r["arm_b"]]
        nz = d[d != 0]
        rank = nz.abs().rank()
        assert r["wilcoxon_statistic"] == pytest.approx(min(rank[nz > 0].sum(), rank[nz < 0].sum()))
        assert r["n_nonzero_differences"] == len(nz)
        assert r["n_blocks_favouring_a"] == int((d < 0).sum())
        assert r["median_diff_a_minus_b"] == pytest.approx(d.median())


def test_pairs_are_only_opened_for_rejecting_families(spark):
    rows = [("same", b, a, float((b * 7 + ord(a) * 3) % 5)) for b in range(9) for a in "abc"]
    rows += [("apart", b, a, b + 10.0 * ord(a)) for b in range(9) for a in "abc"]
    scores = spark.createDataFrame(rows, "family string, block int, arm string, value double")
    tests, pairs = stats.compare_arms(scores, ["family"], ["block"], ["a", "b", "c"], stats.LOWER, expected_blocks=9)
    rejected = {r["family"]: r["reject"] for r in tests.collect()}
    assert rejected["apart"]
    assert {r["family"] for r in pairs.collect()} == {f for f, hit in rejected.items() if hit}
    with pytest.raises(AssertionError):
        stats.compare_arms(scores, ["family"], ["block"], ["a", "b", "c"], stats.LOWER, expected_blocks=8)


def test_hash_reaches_is_the_comparison_of_uniforms(spark):
    from lacuna.functions.columns import hash_digits, hash_reaches, hash_uniform, hash_uniform_value

    bounds = [-1.0, 0.0, 0.25, math.exp(-0.25), 1.0 - 1e-14, 1.0, 2.0, *[hash_uniform_value(3, k) for k in range(5)]]
    rows = spark.range(200).select("id", *[
        (hash_reaches(hash_digits(3, F.col("id")), b) == (hash_uniform(3, F.col("id")) >= F.lit(b))).alias(f"b{i}") for i, b in enumerate(bounds)])
    assert all(all(r[1:]) for r in rows.collect())


def test_bootstrap_hashes_a_drawn_cell_once(spark):
    from lacuna.operators import fidelity as fid

    cells = spark.createDataFrame([("A", "d", 0.2, "m", "7", "x", "continuous", 2, 1.0, 3.0)],
                                  "cohort string, design string, alpha double, method string, recordid string, feature string, kind string, status int, truth double, imputed double")
    samples = fid.bootstrap(cells, "recordid", resamples=400)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2  # once to choose, once to count the copies of what was chosen
    found = {r["resample"]: r["value"] for r in samples.collect()}
    from lacuna.functions.columns import hash_uniform_value
    assert set(found) == {b for b in range(1, 401) if hash_uniform_value(20260507, b, 7) >= math.exp(-0.25)} and set(found.values()) == {2.0}
