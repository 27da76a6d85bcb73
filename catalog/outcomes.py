"""Outcome models' splits and metrics (I), and report tables (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CODEBOOK, KEYS, WITH_ENCODED, WITH_REGISTRY, encoded, query, registry, sql_uniform, stored
from catalog.flagship import rounded
from lacuna.functions.columns import hash_uniform
from lacuna.functions.frames import local_frame
from lacuna.operators import harmonise as h
from lacuna.operators import predict as pr
from lacuna.operators import report as rep

SEEDS_SQL = "(values (42),(314),(2718)) s(seed)"
METHODS = ["Baseline", "KNN", "MICE", "Mean/Mode"]
METHODS_SQL = "(values ('Baseline'),('KNN'),('MICE'),('Mean/Mode')) a(m)"
COHORT_UNITS = 2


def people(spark, sf):
    """Registry rows with their targets next to the encoded predictors."""
    def build():
        targets = registry(spark, sf).select(*KEYS, "y_bin", "y_cont")
        return h.join_targets(encoded(spark, sf), targets, KEYS, check=False)

    return stored(spark, sf, "people", build)


# -- splits -----------------------------------------------------------------

WITH_STRATA = WITH_REGISTRY + """,
known as (select cohort, recordid, y_cont y from registry where y_cont is not null),
e as (select cohort, list_sort(list_distinct(list(q))) edges from (select cohort, quantile_cont(y, p) q from known, (select i / 10.0 p from range(11) r(i)) group by cohort, p) group by 1),
strata as (select k.*, greatest(len(list_filter(edges, lambda x: x < k.y)) - 1, 0) stratum from known k join e using (cohort)),
binary_strata as (select cohort, recordid, y_bin y, y_bin stratum from registry)"""
# quantile_cont needs constant fractions.
WITH_STRATA = WITH_STRATA.replace(
    "select cohort, quantile_cont(y, p) q from known, (select i / 10.0 p from range(11) r(i)) group by cohort, p",
    "select cohort, unnest(quantile_cont(y, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) q from known group by cohort",
)
FOLDS = """,
drawn as (select s0.*, seed, row_number() over (partition by cohort, stratum, seed order by {u}, recordid) rn, count(*) over (partition by cohort, stratum, seed) n from {source} s0, {seeds}),
sizes as (select *, cast(round_even(n * 0.2, 0) as bigint) n_test from drawn),
folds as (select cohort, recordid, y, stratum, seed, case when rn <= n_test then 'test' when rn <= n_test + cast(round_even((n - n_test) * 0.25, 0) as bigint) then 'val' else 'train' end fold from sizes)"""


def _folds(source):
    return FOLDS.format(u=sql_uniform("cast(seed as varchar)", "recordid"), source=source, seeds=SEEDS_SQL)


def continuous_strata(spark, sf):
    known = people(spark, sf).filter("y_cont is not null").select(*KEYS, F.col("y_cont").alias("y"))
    return pr.strata(known, ["cohort"], "y", max_units=COHORT_UNITS)


@query("i2_strata", WITH_STRATA + "\nselect cohort, recordid, cast(stratum as int) stratum from strata")
def strata(spark, sf):
    return continuous_strata(spark, sf).select(*KEYS, "stratum")


@query("i3_split_continuous", WITH_STRATA + _folds("strata") + "\nselect cohort, recordid, seed, fold from folds")
def split_continuous(spark, sf):
    out = pr.split(continuous_strata(spark, sf), ["cohort"], "recordid", max_units=COHORT_UNITS)
    return out.select(*KEYS, "seed", "fold")


def binary_folds(spark, sf):
    def build():
        known = people(spark, sf).withColumnRenamed("y_bin", "y")
        return pr.split(pr.strata(known, ["cohort"], "y", max_units=COHORT_UNITS), ["cohort"], "recordid", max_units=COHORT_UNITS)

    return stored(spark, sf, "folds", build)


WITH_FOLDS = WITH_STRATA + _folds("binary_strata")


@query("i3_split_binary", WITH_FOLDS + "\nselect cohort, recordid, seed, fold from folds")
def split_binary(spark, sf):
    return binary_folds(spark, sf).select(*KEYS, "seed", "fold")


@query("i1_eligible_rows", WITH_REGISTRY + f"""
select cohort, t as target, case when t = 'y_bin' then count(y_bin) else count(y_cont) end n_rows, case when t = 'y_bin' then count(y_bin) else count(y_cont) end >= {pr.MIN_ROWS} enough
from registry, (values ('y_bin'),('y_cont')) a(t) group by cohort, t""")
def eligible_rows(spark, sf):
    from lacuna.operators.models import eligible

    return eligible(people(spark, sf), ["cohort"], ["y_bin", "y_cont"])


WITH_MATRIX = WITH_FOLDS + """,
enc as (select cohort, recordid, """ + ", ".join(
    f"cast(case cast({v.name} as varchar) " + " ".join(f"when '{x}' then {i}.0" for x, i in v.codes.items()) + f" end as double) {v.name}"
    if v.levels else f"cast({v.name} as double) {v.name}" for v in CODEBOOK.variables) + """ from registry),
f as (select * from folds join enc using (cohort, recordid)),
st as (select cohort, seed, """ + ", ".join(
    f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in pr.model_groups(CODEBOOK)["continuous"]) + " from f where fold = 'train' group by 1,2)"
MATRIX_COLUMNS = ["bin_lowbal"] + [f"round(({c} - m_{c}) / s_{c}, 6) {c}" for c in pr.model_groups(CODEBOOK)["continuous"]] + [
    x for c in ("nom_segment", "nom_region") for x in [*(f"coalesce(cast({c} = {i} as double), 0.0) {c}_{i}" for i in range(5)), f"cast({c} is null as double) {c}_missing"]]


@query("i4_model_matrix", WITH_MATRIX + f"\nselect cohort, seed, recordid, fold, {', '.join(MATRIX_COLUMNS)} from f join st using (cohort, seed)")
def model_matrix(spark, sf):
    out = pr.model_matrix(binary_folds(spark, sf), ["cohort", "seed"], ["recordid", "fold"], CODEBOOK, max_units=6)
    return rounded(out, *pr.model_groups(CODEBOOK)["continuous"])


DOWN_UNIT = ["cohort", "seed"]
WITH_PLAN = WITH_FOLDS + """,
c as (select cohort, seed, count(*) n_before, count(*) filter (where y = 1) pos_before, count(*) filter (where y = 0) neg_before from folds where fold = 'train' group by 1,2),
plan as (select *, case when neg_before <= ceil(pos_before * 1.5) then 'not_needed' else 'train_fold_majority_0_downsampled' end downsampling,
  cast(least(neg_before, ceil(pos_before * 1.5)) as bigint) neg_after, pos_before pos_after from c)"""


@query("i5_downsampling_plan", WITH_PLAN + "\nselect *, round(neg_after / pos_after, 6) class_weight from plan")
def downsampling_plan(spark, sf):
    return rounded(pr.downsampling_plan(binary_folds(spark, sf), DOWN_UNIT, "y", 1.5), "class_weight")


@query("i5_downsample", WITH_PLAN + f""",
neg as (select *, row_number() over (partition by cohort, seed order by {sql_uniform("cast(seed + 1000 as varchar)", "recordid")}, recordid) rn from folds where fold = 'train' and y = 0)
select cohort, seed, recordid, fold from folds where not (fold = 'train' and y = 0)
union all select n.cohort, n.seed, n.recordid, n.fold from neg n join plan p using (cohort, seed) where rn <= neg_after""")
def downsample(spark, sf):
    out = pr.downsample(binary_folds(spark, sf), DOWN_UNIT, "y", "recordid", ratio=1.5, max_units=6)
    return out.select("cohort", "seed", "recordid", "fold")


@query("i6_class_weights", WITH_PLAN + """
select cohort, seed, e as entry, round(case when e = 3 then greatest(1.0, sqrt(neg_after / pos_after)) else neg_after / pos_after end, 6) weight from plan, (values (1),(2),(3)) g(e)""")
def class_weights(spark, sf):
    plan = pr.downsampling_plan(binary_folds(spark, sf), DOWN_UNIT, "y", 1.5)
    entries = F.explode(F.array(*[F.struct(F.lit(e).alias("entry"), pr.class_weight(F.col("class_weight"), e).alias("weight")) for e in (1, 2, 3)]))
    return rounded(plan.select("cohort", "seed", entries.alias("g")).select("cohort", "seed", "g.*"), "weight")


# -- scored predictions -----------------------------------------------------

UNIT = ["cohort", "target", "method"]
CELL = ["cohort", "design", "target", "intensity", "method", "split_seed"]
WITH_PREDICTIONS = WITH_REGISTRY + f""",
u as (select *, m as method, {sql_uniform("'score'", "m", "recordid")} u from registry, {METHODS_SQL}),
predictions as (select cohort, case when cont_year % 2 = 0 then 'MCAR' else 'MNAR' end design, 'region' || cast(nom_region as varchar) target,
  case when cast(recordid as bigint) % 5 < 2 then 5 else 20 end intensity, method, cast(cast(recordid as bigint) % 3 as int) split_seed, recordid,
  y_bin y, floor((0.35 * y_bin + 0.65 * u) * 100) / 100 score, y_cont, y_cont * (0.8 + 0.4 * u) pred from u)"""


def predictions(spark, sf):
    def build():
        rid = F.col("recordid").cast("long")
        u = hash_uniform("score", F.col("method"), F.col("recordid"))
        methods = local_frame(spark, [(m,) for m in METHODS], "method string")
        frame = registry(spark, sf).crossJoin(F.broadcast(methods))
        return frame.select(
            "cohort", F.when(F.col("cont_year") % 2 == 0, "MCAR").otherwise("MNAR").alias("design"),
            F.concat(F.lit("region"), F.col("nom_region").cast("string")).alias("target"),
            F.when(rid % 5 < 2, 5).otherwise(20).alias("intensity"), "method", (rid % 3).cast("int").alias("split_seed"),
            "recordid", F.col("y_bin").alias("y"),
            (F.floor((F.lit(0.35) * F.col("y_bin") + F.lit(0.65) * u) * 100) / 100).alias("score"),
            "y_cont", (F.col("y_cont") * (F.lit(0.8) + F.lit(0.4) * u)).alias("pred"),
        )

    return stored(spark, sf, "predictions", build)


SWEEP = WITH_PREDICTIONS + f""",
sweep0 as (select cohort, target, method, threshold, sum(cast(y = 1 and score >= threshold as int)) tp, sum(cast(y = 0 and score >= threshold as int)) fp,
  sum(cast(y = 0 and score < threshold as int)) tn, sum(cast(y = 1 and score < threshold as int)) fn
  from predictions, (values {", ".join(f"(cast({t} as double))" for t in pr.THRESHOLDS)}) t(threshold) group by 1,2,3,4),
sweep as (select *, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 bal from sweep0)"""


@query("i8_threshold_sweep", SWEEP + "\nselect cohort, target, method, threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(tn as bigint) tn, cast(fn as bigint) fn, round(bal,6) balanced_accuracy from sweep")
def threshold_sweep(spark, sf):
    return rounded(pr.threshold_sweep(predictions(spark, sf), UNIT), "balanced_accuracy")


@query("i8_best_threshold", SWEEP + """
select cohort, target, method, threshold, round(bal,6) balanced_accuracy from (
  select *, row_number() over (partition by cohort, target, method order by bal desc, threshold) r from sweep) where r = 1""")
def best_threshold(spark, sf):
    return rounded(pr.best_threshold(predictions(spark, sf), UNIT), "balanced_accuracy")


@query("i9_confusion_metrics", SWEEP + """
select cohort, target, method, cast(tp as bigint) tp, cast(fn as bigint) fn, cast(tn as bigint) tn, cast(fp as bigint) fp, round((tp + tn) / (tp + tn + fp + fn),6) accuracy, round(bal,6) balanced_accuracy,
  round(tp / (tp + fn),6) sensitivity, round(tn / (tn + fp),6) specificity, round(fn / (tp + fn),6) false_negative_rate, bal < 0.75 below_075_balanced_accuracy from sweep where threshold = 0.5""")
def confusion_metrics(spark, sf):
    out = pr.confusion_metrics(predictions(spark, sf).withColumn("threshold", F.lit(0.5)), UNIT)
    return rounded(out, "accuracy", "balanced_accuracy", "sensitivity", "specificity", "false_negative_rate")


WITH_CURVE = WITH_PREDICTIONS + """,
d as (select cohort, target, method, score, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from predictions group by 1,2,3,4),
cum as (select *, coalesce(sum(neg) over (partition by cohort, target, method order by score rows between unbounded preceding and 1 preceding), 0) neg_below,
  sum(pos) over (partition by cohort, target, method order by score desc rows unbounded preceding) tp, sum(neg) over (partition by cohort, target, method order by score desc rows unbounded preceding) fp from d),
curve as (select cohort, target, method, sum(pos) p, sum(neg) n, sum(pos * (neg_below + neg / 2.0)) wins, sum(pos * tp / (tp + fp)) steps from cum group by 1,2,3)"""


@query("i10_roc_auc", WITH_CURVE + "\nselect cohort, target, method, round(wins / (p * n),6) roc_auc from curve")
def roc_auc(spark, sf):
    return rounded(pr.curve_metrics(predictions(spark, sf), UNIT).select(*UNIT, "roc_auc"), "roc_auc")


@query("i11_average_precision", WITH_CURVE + "\nselect cohort, target, method, round(steps / p,6) au_prc, round(steps / p / (p / (p + n)),6) au_prc_lift, round(p / (p + n),6) positive_rate from curve")
def average_precision(spark, sf):
    out = pr.curve_metrics(predictions(spark, sf), UNIT).select(*UNIT, "au_prc", "au_prc_lift", "positive_rate")
    return rounded(out, "au_prc", "au_prc_lift", "positive_rate")


REG_CELL_SQL = "cohort, design, target, intensity, method, split_seed"
WITH_SCALE = WITH_PREDICTIONS + """,
scale as (select target, avg(y_cont) mean, stddev_pop(y_cont) sd from predictions where method = 'Baseline' group by 1),
reg0 as (select p.*, y_cont - pred e, (y_cont - pred) / sd z from predictions p join scale using (target) where y_cont is not null)"""
REG_METRICS = """sqrt(avg(z*z)) rmse_z, avg(abs(z)) mae_z, sqrt(avg(e*e)) rmse_original_units, avg(abs(e)) mae_original_units,
  sqrt(avg(pow(ln(1+greatest(y_cont,0)) - ln(1+greatest(pred,0)),2))) rmsle, avg(sqrt(1+z*z)-1) mphe, count(*) n_test,
  1 - sum(e*e) / nullif(var_pop(y_cont) * count(*), 0) r2"""


def _regression(spark, sf):
    frame = predictions(spark, sf)
    scale = frame.filter(F.col("method") == "Baseline").groupBy("target").agg(
        F.avg("y_cont").alias("mean"), F.stddev_pop("y_cont").alias("sd")
    )
    joined = frame.join(F.broadcast(scale), "target")  # one row per declared target
    return joined.drop("y").withColumnRenamed("y_cont", "y")


@query("i15_regression_metrics", WITH_SCALE + f"""
select {REG_CELL_SQL}, round(rmse_z,6) rmse_z, round(mae_z,6) mae_z, round(rmse_original_units,3) rmse_original_units, round(mae_original_units,3) mae_original_units,
  round(rmsle,6) rmsle, round(mphe,6) mphe, n_test, round(r2,6) r2 from (select {REG_CELL_SQL}, {REG_METRICS} from reg0 group by {REG_CELL_SQL})""")
def regression_metrics(spark, sf):
    out = pr.regression_metrics(_regression(spark, sf), CELL)
    out = rounded(out, "rmse_z", "mae_z", "rmsle", "mphe", "r2")
    return rounded(out, "rmse_original_units", "mae_original_units", digits=3)


@query("i12_target_profile", WITH_STRATA + _folds("strata") + """
select cohort, seed, count(*) n, round(avg(y),4) mean, round(stddev_pop(y),4) sd, round(min(y),4) low, round(skewness(y),6) skew, min(y) >= 0 and skewness(y) > 1 log1p_variant,
  round(avg(cast(y <= 0 as int)),6) zero_fraction, count(*) filter (where y > 0) n_positive, avg(cast(y <= 0 as int)) >= 0.4 and count(*) filter (where y > 0) >= 20 hurdle
from folds where fold = 'train' group by 1,2""")
def target_profile(spark, sf):
    folds = pr.split(continuous_strata(spark, sf), ["cohort"], "recordid", max_units=COHORT_UNITS)
    out = pr.target_profile(folds, ["cohort", "seed"], "y")
    return rounded(rounded(out, "mean", "sd", "low", digits=4), "skew", "zero_fraction")


@query("i16_fill_for_trees", WITH_ENCODED + "\nselect cohort, recordid, coalesce(cont_price, -99.0) cont_price, cast(cont_price is null as double) cont_price__missing from encoded")
def fill_for_trees(spark, sf):
    return pr.fill_for_trees(encoded(spark, sf).select(*KEYS, "cont_price"), ["cont_price"])


# -- K: report tables over prediction records -------------------------------

WITH_RECORDS = WITH_SCALE + f""",
conf as (select {REG_CELL_SQL}, count(*) filter (where y = 1 and score >= 0.5) tp, count(*) filter (where y = 1 and score < 0.5) fn,
  count(*) filter (where y = 0 and score < 0.5) tn, count(*) filter (where y = 0 and score >= 0.5) fp from predictions group by all),
reg as (select {REG_CELL_SQL}, {REG_METRICS} from reg0 group by {REG_CELL_SQL}),
records as (select c.*, round(case when tp + fn = 0 then tn / nullif(tn + fp, 0) when tn + fp = 0 then tp / (tp + fn) else (tp / (tp + fn) + tn / (tn + fp)) / 2.0 end, 9) balanced_accuracy,
  round(rmse_z, 9) rmse_z, round(r2, 9) r2, case when target <> 'region3' then round(mphe, 9) end mphe, round(rmsle, 9) rmsle,
  tp + fn pos_before, tn + fp neg_before, tp + fn pos_after, least(tn + fp, 2 * (tp + fn)) neg_after
  from conf c left join reg r using ({REG_CELL_SQL}))"""


def records(spark, sf):
    def build():
        conf = pr.confusion_metrics(predictions(spark, sf).withColumn("threshold", F.lit(0.5)), CELL)
        reg = pr.regression_metrics(_regression(spark, sf), CELL)
        pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
        return conf.join(reg.select(*CELL, "rmse_z", "r2", "mphe", "rmsle"), CELL, "left").select(
            *CELL, "tp", "fn", "tn", "fp", F.round("balanced_accuracy", 9).alias("balanced_accuracy"),
            F.round("rmse_z", 9).alias("rmse_z"), F.round("r2", 9).alias("r2"),
            F.when(F.col("target") != "region3", F.round("mphe", 9)).alias("mphe"), F.round("rmsle", 9).alias("rmsle"),
            pos.alias("pos_before"), neg.alias("neg_before"), pos.alias("pos_after"), F.least(neg, 2 * pos).alias("neg_after"),
        )

    return stored(spark, sf, "records", build)


@query("j1_flatten_runs", WITH_RECORDS + """
select cohort, design, target, 'binary' target_type, intensity, method, method method_key, split_seed, cast(row_number() over (
  partition by cohort, design, target, intensity, method order by split_seed) as int) split_repeat, 'ok' status, balanced_accuracy from records where target in ('region0','region1')""")
def flatten_runs(spark, sf):
    from lacuna.sources import files

    unit = ["cohort", "design", "alpha", "method", "target"]
    nested = records(spark, sf).withColumn("alpha", F.col("intensity") / 100.0).groupBy(*unit).agg(
        F.sort_array(F.collect_list(F.struct(F.col("split_seed").alias("seed"), "balanced_accuracy"))).alias("runs")
    )
    flat = rep.collect_records(files.explode_runs(nested), binary=["region0", "region1"], continuous=[])
    rep.require_unique_cells(flat)
    return flat


@query("j1_duplicate_cells", WITH_PREDICTIONS + "\nselect cohort, design, target, intensity, method, split_seed, count(*) n from predictions group by all having count(*) > 1")
def duplicate_cells(spark, sf):
    return rep.duplicate_cells(predictions(spark, sf))


BASE_MEDIAN = ",\nbm as (select target, quantile_cont({v}, 0.5) b from records where method = 'Baseline' group by 1)"


@query("k1_baseline_delta", WITH_RECORDS + BASE_MEDIAN.format(v="balanced_accuracy") + f"\nselect {REG_CELL_SQL}, round(balanced_accuracy - b, 6) delta from records left join bm using (target)")
def baseline_delta(spark, sf):
    return rounded(rep.baseline_delta(records(spark, sf), "balanced_accuracy").select(*CELL, "delta"), "delta")


@query("k2_baseline_ratio", WITH_RECORDS + BASE_MEDIAN.format(v="rmse_z") + f"\nselect {REG_CELL_SQL}, round(rmse_z / nullif(b, 0), 6) ratio from records left join bm using (target)")
def baseline_ratio(spark, sf):
    return rounded(rep.baseline_ratio(records(spark, sf), "rmse_z").select(*CELL, "ratio"), "ratio")


WITH_BOXES = WITH_RECORDS + """,
box0 as (select cohort, method, count(rmse_z) n, avg(rmse_z) mean, quantile_cont(rmse_z, 0.5) median, quantile_cont(rmse_z, 0.25) q1, quantile_cont(rmse_z, 0.75) q3 from records where rmse_z is not null group by 1,2),
whisk as (select cohort, method, min(rmse_z) filter (where inside) lo, max(rmse_z) filter (where inside) hi from (
  select r.cohort, r.method, rmse_z, rmse_z between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) inside from records r join box0 using (cohort, method)) group by 1,2),
boxes as (select b.*, lo, hi, b.method <> 'Baseline' and b.median < r.median better from box0 b join whisk using (cohort, method) join box0 r on r.cohort = b.cohort and r.method = 'Baseline')"""


def boxes(spark, sf):
    return rep.box_summary(records(spark, sf), ["cohort"], "rmse_z", lower_is_better=True)


@query("k3_box_summary", WITH_BOXES + "\nselect cohort, method, n, round(mean,6) mean, round(median,6) median, round(q1,6) q1, round(q3,6) q3, round(lo,6) whisker_low, round(hi,6) whisker_high, better better_than_reference from boxes")
def box_summary(spark, sf):
    return rounded(boxes(spark, sf), "mean", "median", "q1", "q3", "whisker_low", "whisker_high")


@query("k4_caption_facts", WITH_BOXES + """
select cohort, arg_min(method, median) filter (where method <> 'Baseline') best_method, coalesce(string_agg(method, ';' order by method) filter (where better), '') better_methods, min(n) min_n, max(n) max_n from boxes group by 1""")
def caption_facts(spark, sf):
    return rep.caption_facts(boxes(spark, sf), ["cohort"], lower_is_better=True)


TARGETS = [f"region{i}" for i in range(5)]


@query("k5_target_medians", WITH_RECORDS + "\nselect method, " + ", ".join(
    f"round(quantile_cont(balanced_accuracy, 0.5) filter (where cohort = '{c}' and target = '{t}'), 6) {c}_{t}" for c in "AB" for t in TARGETS) + " from records group by 1")
def target_medians(spark, sf):
    return rounded(rep.target_medians(records(spark, sf), "balanced_accuracy", "AB", TARGETS), *[f"{c}_{t}" for c in "AB" for t in TARGETS])


@query("k6_error_profile", WITH_RECORDS + """,
s as (select cohort, method, sum(tp) tp, sum(fn) fn, sum(tn) tn, sum(fp) fp from records group by 1,2)
select s.cohort, s.method, cast(s.tp as bigint) tp, cast(s.fn as bigint) fn, cast(s.tn as bigint) tn, cast(s.fp as bigint) fp, round(s.tp / greatest(s.tp + s.fn, 1),6) sensitivity,
  round(s.tn / greatest(s.tn + s.fp, 1),6) specificity, round(s.tp / greatest(s.tp + s.fp, 1),6) ppv, round(100.0 * (s.fn - b.fn) / nullif(b.fn, 0),6) delta_fn_pct, round(100.0 * (s.fp - b.fp) / nullif(b.fp, 0),6) delta_fp_pct
from s left join s b on b.cohort = s.cohort and b.method = 'Baseline'""")
def error_profile(spark, sf):
    return rounded(rep.error_profile(records(spark, sf)), "sensitivity", "specificity", "ppv", "delta_fn_pct", "delta_fp_pct")


@query("k7_class_counts", WITH_RECORDS + "\nselect distinct cohort, target, split_seed, pos_before, neg_before, pos_after, neg_after from records")
def class_counts(spark, sf):
    return rep.class_counts(records(spark, sf))


@query("k8_false_negatives", WITH_RECORDS + """,
s as (select cohort, design, method, intensity, split_seed, sum(fn) fn, sum(tp + fn) pos from records group by all)
select cohort, method, intensity, count(*) n, quantile_cont(cast(fn as double), 0.5) fn_median, quantile_cont(cast(fn as double), 0.25) fn_q1, quantile_cont(cast(fn as double), 0.75) fn_q3,
  cast(min(fn) as bigint) fn_min, cast(max(fn) as bigint) fn_max, round(quantile_cont(fn / nullif(pos, 0), 0.5),6) rate_median from s group by 1,2,3""")
def false_negatives(spark, sf):
    return rounded(rep.false_negative_summary(records(spark, sf)), "rate_median")


@query("k9_compact_summary", WITH_RECORDS + "\nselect cohort, method, count(*) n, " + ", ".join(
    f"round(quantile_cont({v}, {q}), 6) {v}_{n}" for v in ("mphe", "r2") for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))) + " from records group by 1,2")
def compact_summary(spark, sf):
    names = [f"{v}_{n}" for v in ("mphe", "r2") for n in ("median", "q1", "q3")]
    return rounded(rep.compact_summary(records(spark, sf), ["cohort", "method"], ["mphe", "r2"]), *names)


@query("k10_first_metric", WITH_RECORDS + """,
f as (select *, coalesce(mphe, rmsle) v from records), bm as (select target, quantile_cont(v, 0.5) b from f where method = 'Baseline' group by 1)
select target, method, round(quantile_cont(v / nullif(b, 0), 0.5),6) ratio_median, round(100.0 * stddev_samp(v) / nullif(abs(avg(v)), 0),6) cv_pct, count(v) n from f left join bm using (target) group by 1,2""")
def first_metric(spark, sf):
    return rounded(rep.first_metric(records(spark, sf), ["mphe", "rmsle"]), "ratio_median", "cv_pct")


@query("k11_mean_sd", WITH_RECORDS + "\nselect method, intensity, " + ", ".join(
    f"round(avg({v}),6) {v}_mean, round(stddev_samp({v}),6) {v}_sd" for v in ("balanced_accuracy", "rmse_z")) + " from records group by 1,2")
def mean_sd(spark, sf):
    values = ["balanced_accuracy", "rmse_z"]
    return rounded(rep.mean_sd(records(spark, sf), ["method", "intensity"], values), *[f"{v}_{s}" for v in values for s in ("mean", "sd")])


@query("k12_binary_distribution", WITH_REGISTRY + """
select cohort, count(*) n, count(*) filter (where bin_lowbal = 'Yes') n_positive, count(*) filter (where bin_lowbal = 'No') n_negative, count(*) filter (where bin_lowbal is null) n_missing,
  round(100.0 * count(*) filter (where bin_lowbal = 'Yes') / count(bin_lowbal),6) positive_pct, round(100.0 * count(*) filter (where bin_lowbal = 'No') / count(bin_lowbal),6) negative_pct from registry group by 1""")
def binary_distribution(spark, sf):
    return rounded(rep.binary_distribution(encoded(spark, sf), ["cohort"], "bin_lowbal"), "positive_pct", "negative_pct")


@query("k13_continuous_profile", WITH_REGISTRY + """
select cohort, count(y_cont) n, count(*) filter (where y_cont is null) n_missing, round(max(y_cont),2) max, count(*) filter (where y_cont = 0) n_zero, round(quantile_cont(y_cont,0.5),2) median from registry group by 1""")
def continuous_profile(spark, sf):
    return rounded(rep.continuous_profile(people(spark, sf), ["cohort"], "y_cont", max_groups=COHORT_UNITS), "max", "median", digits=2)


@query("k13_histogram", WITH_REGISTRY + """,
s as (select cohort, avg(cont_price) m, stddev_pop(cont_price) s, min(cont_price) lo, max(cont_price) hi from registry group by 1)
select cohort, cast(least(floor(((cont_price - m) / s - (lo - m) / s) / (((hi - m) / s - (lo - m) / s) / 42)), 41) as int) bin, count(*) n from registry join s using (cohort) where cont_price is not null group by 1,2""")
def histogram(spark, sf):
    return rep.standardised_histogram(encoded(spark, sf), ["cohort"], "cont_price", max_groups=COHORT_UNITS)
