"""Mask, fill, score: the shortest complete study."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import base
from catalog.base import STUDY, encoded, query, stored
from lacuna.operators import fidelity as fid
from lacuna.operators import impute, mask
from lacuna.operators.encode import apply_canonical, fit_canonical

UNIT = impute.UNIT
ROWS = STUDY.groups(designs=True, alphas=True)


def masked_cells(spark: SparkSession, sf: str) -> DataFrame:
    return mask.masked_cells(stored(spark, sf, "masked", lambda: mask.hidden(encoded(spark, sf), STUDY)), STUDY)


def canonical_cells(spark: SparkSession, sf: str) -> DataFrame:
    masked = masked_cells(spark, sf)
    scaler = stored(spark, sf, "scaler", lambda: fit_canonical(masked, UNIT, value="masked"))  # fitted once, not by each reader
    return apply_canonical(masked, scaler, UNIT, ["truth", "masked"], rows=ROWS)


def mean_mode_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = impute.impute_mean_mode(canonical_cells(spark, sf), base.CODEBOOK, rows=ROWS)
    return cells.withColumn("method", F.lit("mean"))


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


WITH_CANONICAL = base.WITH_MASKS + """,
scaler as (select cohort, design, alpha, feature, coalesce(avg(masked),0.0) mean,
    case when coalesce(stddev_pop(masked),0.0) < 1e-9 then 1.0 else stddev_pop(masked) end scale,
    coalesce(stddev_pop(masked),0.0) < 1e-9 degenerate
  from masks where kind in ('continuous','count') group by 1,2,3,4),
canonical as (select m.cohort, m.recordid, m.feature, m.kind, m.design, m.alpha, m.status,
    case when kind in ('continuous','count') then (truth-mean)/scale else truth end truth,
    case when kind in ('continuous','count') then (masked-mean)/scale else masked end masked
  from masks m left join scaler using (cohort, design, alpha, feature))"""

WITH_MEAN = WITH_CANONICAL + """,
mean0 as (select cohort, design, alpha, feature, kind, avg(masked) fill from canonical
  where kind in ('ordinal','count','continuous') and masked is not null group by all),
near as (select m.cohort, m.design, m.alpha, m.feature, v.masked, row_number() over (
    partition by m.cohort, m.design, m.alpha, m.feature order by abs(v.masked - m.fill), v.masked) r
  from mean0 m join (select distinct cohort, design, alpha, feature, masked from canonical
    where kind = 'count' and masked is not null) v using (cohort, design, alpha, feature)),
mode0 as (select *, row_number() over (partition by cohort, design, alpha, feature order by n desc, masked) r from (
    select cohort, design, alpha, feature, masked, count(*) n from canonical
    where kind in ('binary','nominal') and masked is not null group by all)),
fills as (
  select m.cohort, m.design, m.alpha, m.feature, case when kind = 'count' then n.masked
      when kind = 'ordinal' then least(greatest(ceil(fill - 0.5), 0.0), 4.0) else fill end fill
  from mean0 m left join near n on n.cohort = m.cohort and n.design = m.design and n.alpha = m.alpha
    and n.feature = m.feature and n.r = 1
  union all select cohort, design, alpha, feature, masked from mode0 where r = 1),
imputed as (select c.*, coalesce(masked, fill) imputed, 'mean' as method
  from canonical c left join fills using (cohort, design, alpha, feature))"""

WITH_SCORES = WITH_MEAN + """,
pairs as (select * from imputed where status = 2 and truth is not null and imputed is not null),
conf as (select cohort, design, alpha, method, feature, cast(truth as int) t, cast(imputed as int) p, count(*) n
  from pairs where kind in ('binary','ordinal','nominal') group by all),
labels as (select cohort, design, alpha, method, feature, label, sum(nt) nt, sum(np) np, sum(tp) tp from (
    select cohort, design, alpha, method, feature, t as label, n nt, 0 np, case when t = p then n else 0 end tp from conf
    union all select cohort, design, alpha, method, feature, p, 0, n, 0 from conf) group by all),
per_feature as (select cohort, design, alpha, method, feature, sum(tp)/sum(nt) accuracy,
    avg(2.0*tp/(nt+np)) f1_macro, avg(case when nt > 0 then tp/nt end) balanced_acc from labels group by all),
scores as (
  select cohort, design, alpha, method, 'accuracy' metric, feature, accuracy as value from per_feature
  union all select cohort, design, alpha, method, 'f1_macro', feature, f1_macro from per_feature
  union all select cohort, design, alpha, method, 'balanced_acc', feature, balanced_acc from per_feature
  union all select cohort, design, alpha, method, 'rmse', feature, sqrt(avg((truth-imputed)*(truth-imputed)))
    from pairs where kind in ('continuous','count') group by cohort, design, alpha, method, feature)"""

ARM_SQL = "cohort, design, alpha, method"


@query(
    "h7_fidelity_summary",
    WITH_SCORES + """
select cohort, variable_type, metric, method, round(avg(value),6) mean, round(quantile_cont(value,0.5),6) median,
  round(quantile_cont(value,0.25),6) q1, round(quantile_cont(value,0.75),6) q3, count(*) n_values
from (select *, case when metric = 'rmse' then 'Continuous' else 'Categorical' end variable_type from scores
  where metric in ('rmse','balanced_acc')) group by all""",
)
def fidelity_summary(spark, sf):
    values = fid.reported(fid.fidelity(mean_mode_cells(spark, sf)))
    return rounded(fid.summarise(values), "mean", "median", "q1", "q3")


@query("h1_rmse_heldout", WITH_SCORES + f"\nselect {ARM_SQL}, feature, round(value,6) as value from scores where metric = 'rmse'")
def rmse_heldout(spark, sf):
    return rounded(fid.rmse(mean_mode_cells(spark, sf)), "value")


def _categorical(name):
    def run(spark, sf):
        table = fid.categorical_metrics(fid.confusion(mean_mode_cells(spark, sf)))
        return rounded(table.select(*fid.ARM, "feature", F.col(name).alias("value")), "value")

    return run


for _name, _metric in (("h2_accuracy", "accuracy"), ("h3_macro_f1", "f1_macro"), ("h4_balanced_accuracy", "balanced_acc")):
    query(_name, WITH_SCORES + f"\nselect {ARM_SQL}, feature, round({_metric},6) as value from per_feature")(_categorical(_metric))


def _sql_poisson():
    below, term, parts = 0.0, math.exp(-0.25), []
    for copies in range(8):
        below += term
        parts.append(f"cast(u >= cast({below!r} as double) as int)")
        term *= 0.25 / (copies + 1)
    return " + ".join(parts)


@query("h8_bootstrap", WITH_SCORES + f""",
boots as (select *, {_sql_poisson()} w from (select p.*, b, {base.sql_uniform("'20260507'", "cast(b as varchar)", "recordid")} u from pairs p, range(1, 101) r(b))),
samples as (select cohort, design, alpha, method, feature, kind, b, sum(w * case when kind in ('continuous','count') then (truth - imputed) * (truth - imputed) else cast(truth = imputed as int) end) / sum(w) m
  from boots where w > 0 group by all),
vals as (select *, case when kind in ('continuous','count') then sqrt(m) else m end v from samples)
select cohort, design, alpha, method, case when kind in ('continuous','count') then 'rmse' else 'accuracy' end metric, feature, round(quantile_cont(v,0.025),6) ci_low, round(quantile_cont(v,0.25),6) q1,
  round(quantile_cont(v,0.5),6) median, round(quantile_cont(v,0.75),6) q3, round(quantile_cont(v,0.975),6) ci_high, count(*) n_resamples from vals group by all""")
def bootstrap(spark, sf):
    samples = fid.bootstrap(mean_mode_cells(spark, sf), "recordid")
    return rounded(fid.bootstrap_intervals(samples), "ci_low", "q1", "median", "q3", "ci_high")
