"""Distributed order statistics against numpy, also with one value holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.ordered import cut_points, grouped_quantiles, running_totals, sites_around, up_to


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        value = 7.0 if hot else float(np.exp(rng.normal(0, 3))) * (-1 if i % 5 == 0 else 1)
        rows.append(("hot" if i % 4 else "cold", i, value))
    rows += [("one", 6001, 1e9), ("flat", 6002, 2.0), ("flat", 6003, 2.0)]
    return spark.createDataFrame(rows, "g string, i int, v double").repartition(7).cache()


PROBS = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_quantiles_are_exact(skewed, buckets):
    got = {(r["g"], r["prob"]): r["quantile"] for r in grouped_quantiles(skewed, ["g"], "v", PROBS, buckets=buckets).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        for p in PROBS:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)


def test_running_totals_are_exact(skewed):
    dist = skewed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(dist, ["g"], "v", ["n"], buckets=8).toPandas()
    pdf = skewed.toPandas()
    for g, part in got.groupby("g"):
        values = np.sort(pdf[pdf["g"] == g]["v"].to_numpy())
        part = part.sort_values("v")
        assert (part["before_n"].to_numpy() == np.searchsorted(values, part["v"].to_numpy(), side="left")).all()
        assert (part["all_n"] == len(values)).all()


@pytest.mark.parametrize("buckets", [1, 64])
def test_cut_points_select_exactly_the_first_rows(spark, skewed, buckets):
    unit = skewed.withColumn("u", (F.col("i") % 100) / 100.0)  # many ties, broken by i
    wanted = spark.createDataFrame([("hot", "few", 5), ("hot", "many", 1234), ("cold", "few", 1)], "g string, tag string, place long")
    cuts = cut_points(unit, ["g"], "u", "i", wanted, pin_rows=10, buckets=buckets)
    got = unit.join(cuts, "g").filter(up_to("u", "i")).groupBy("g", "tag").count().collect()
    assert {(r["g"], r["tag"]): r["count"] for r in got} == {("hot", "few"): 5, ("hot", "many"): 1234, ("cold", "few"): 1}


def test_many_quantiles_use_the_rank_line_and_stay_exact(skewed):
    probs = [i / 200 for i in range(201)]
    got = {(r["g"], r["prob"]): r["quantile"] for r in grouped_quantiles(skewed, ["g"], "v", probs, buckets=64).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)


def test_sites_around_finds_the_neighbours(spark):
    sites = spark.createDataFrame([("a", float(v)) for v in (1, 3, 8)], "g string, _v double")
    wanted = spark.createDataFrame([("a", v) for v in (0.0, 3.0, 4.0, 9.0)], "g string, _v double")
    got = {}
    for r in sites_around(wanted, sites, ["g"], 1).collect():
        got.setdefault(r["_v"], set()).add(r["_site"])
    assert got == {0.0: {1.0}, 3.0: {1.0, 3.0}, 4.0: {3.0, 8.0}, 9.0: {8.0}}
