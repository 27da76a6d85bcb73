"""Profiling, typing, selection, codebook and encodings (D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import CODEBOOK, COHORTS, KEYS, STUDY, WITH_CELLS, WITH_ENCODED, WITH_REGISTRY, encoded, query, registry, stored
from catalog.flagship import WITH_CANONICAL, masked_cells, rounded
from lacuna.functions.frames import to_cells, to_wide
from lacuna.operators import encode as e
from lacuna.operators import impute
from lacuna.operators import profile as p

FIELDS = ["cont_price", "cont_bal", "nom_segment", "ord_priority", "bin_lowbal", "cnt_lines", "nom_region", "cont_year",
          "qty01", "qty02", "qty03", "qty04", "qty05", "qty06", "qty07"]
GROUPS = STUDY.groups()
UNIT = impute.UNIT
UNIT_ROWS = STUDY.groups(designs=True, alphas=True)


def sql_text_cells(source: str, fields) -> str:
    return " union all ".join(f"select cohort, '{f}' feature, cast({f} as varchar) label from {source}" for f in fields)


WITH_TEXT = WITH_REGISTRY + f",\ntext_cells as materialized ({sql_text_cells('registry', FIELDS)})"
MISS = WITH_TEXT + """,
shares as (select cohort, feature, (count(*) - count(label)) / cast(count(*) as double) missing from text_cells group by 1,2),
miss as (select feature, max(case when cohort = 'A' then missing end) miss_A, max(case when cohort = 'B' then missing end) miss_B from shares group by 1),
miss_table as (select *, greatest(miss_A, miss_B) miss_max from miss)"""


def stored_registry(spark, sf):
    return stored(spark, sf, "registry", lambda: registry(spark, sf))


@query("d1_missingness_table", MISS + "\nselect feature, round(miss_A,6) miss_A, round(miss_B,6) miss_B, round(miss_max,6) miss_max from miss_table")
def missingness(spark, sf):
    return rounded(p.missingness_table(stored_registry(spark, sf), FIELDS, COHORTS), "miss_A", "miss_B", "miss_max")


RANKED = MISS + """,
ranked as (select feature, miss_max, row_number() over (order by miss_max, feature) position from miss_table where feature <> 'nom_region')
"""
SELECTION = RANKED + """select feature, round(miss_max,6) miss_max, cast(position as int) position, {keep} selected, not ({keep}) and position - (select count(*) from ranked where {keep}) <= 5 next_excluded from ranked"""


@query("d2_select_by_cutoff", SELECTION.format(keep="miss_max <= 0.5"))
def select_by_cutoff(spark, sf):
    table = p.missingness_table(stored_registry(spark, sf), FIELDS, COHORTS)
    return rounded(p.selection(table, max_missing_fraction=0.5, reserved=["nom_region"]), "miss_max")


@query("d2_select_top_n", SELECTION.format(keep="position <= 6"))
def select_top_n(spark, sf):
    table = p.missingness_table(stored_registry(spark, sf), FIELDS, COHORTS)
    return rounded(p.selection(table, n_predictors=6, reserved=["nom_region"]), "miss_max")


@query("d2_column_plan", RANKED + """
select case when position <= 6 then 'predictor' else 'excluded' end as role, count(*) as n, round(min(miss_max),6) as least, round(max(miss_max),6) as most from ranked group by 1
union all select 'held_out', 1, round(miss_max,6), round(miss_max,6) from miss_table where feature = 'nom_region'""")
def column_plan(spark, sf):
    table = p.missingness_table(stored_registry(spark, sf), FIELDS, COHORTS)
    return rounded(p.plan_summary(p.column_plan(table, n_predictors=6, held_out=["nom_region"])), "least", "most")


WITH_TYPED = WITH_TEXT + """,
counted as (select feature, label, count(*) n from text_cells where label is not null group by 1,2),
typed as (select feature, feature not in ('nom_segment','ord_priority','bin_lowbal') numeric_storage, count(*) n_unique, sum(n) n,
  coalesce(bool_and(abs(try_cast(label as double) - round_even(try_cast(label as double),0)) < 1e-9), false) int_like from counted group by 1)"""


@query("d3_classify_columns", WITH_TYPED + """
select feature, case when n_unique = 2 then 'binary' when not numeric_storage or (int_like and n_unique <= 10) or n_unique / n <= 0.005 then 'multiclass' else 'continuous' end as type
from typed where n_unique > 1""")
def classify(spark, sf):
    return p.classify_columns(stored_registry(spark, sf), FIELDS)


@query("d4_feature_meta", WITH_TYPED + """
select feature, case when n_unique = 2 then 'binary' when numeric_storage and not ((int_like and n_unique <= 10) or n_unique / greatest(n, 1) <= 0.005) then 'continuous' else 'multiclass' end as type
from typed""")
def feature_meta(spark, sf):
    return p.feature_meta(stored_registry(spark, sf), FIELDS)


@query("d4_valid_levels", WITH_TEXT + "\nselect distinct feature, cast(label as double) as level from text_cells where feature in ('cnt_lines','nom_region','qty01') and label is not null")
def valid_levels(spark, sf):
    return p.valid_levels(stored_registry(spark, sf), ["cnt_lines", "nom_region", "qty01"])


LABELLED = ["nom_segment", "ord_priority", "bin_lowbal", "nom_region"]


@query("d5_observed_levels", WITH_TEXT + f"\nselect distinct feature, label from text_cells where label is not null and feature in {tuple(LABELLED)}")
def observed_levels(spark, sf):
    return p.observed_levels(stored_registry(spark, sf), LABELLED)


DECLARED = p.DeclaredTypes(
    ordinal={"ord_priority": base.PRIORITIES}, nominal=["nom_region"], count=["cnt_lines"], positive={"bin_lowbal": "Yes"}
)


def typed_registry(spark, sf):
    return stored_registry(spark, sf).withColumn("nom_region", F.col("nom_region").cast("string"))


PLACE = " ".join(f"when '{x}' then {i}" for i, x in enumerate(base.PRIORITIES, 1))


@query("d6_codebook", WITH_TEXT + f""",
seen as (select distinct feature, label from text_cells where label is not null and feature in {tuple(LABELLED)}),
sized as (select *, count(*) over (partition by feature) k from seen)
select feature, case when feature = 'ord_priority' then 'ordinal' when k = 2 then 'binary' else 'nominal' end kind, label as level,
  cast(row_number() over (partition by feature order by case when feature = 'ord_priority' then case label {PLACE} end
    when k = 2 then cast(label = 'Yes' as int) else 0 end, label) - 1 as int) code from sized""")
def codebook(spark, sf):
    return p.codebook_frame(typed_registry(spark, sf), [c for c in FIELDS if not c.startswith("qty")], DECLARED)


@query("d7_binary_order", WITH_REGISTRY + """
select 'bin_lowbal' feature, 'binary' kind, bin_lowbal as level, cast(bin_lowbal = 'Yes' as int) code from (select distinct bin_lowbal from registry where bin_lowbal is not null)
union all select 'status', 'binary', s, cast(s = 'early' as int) from (select distinct case when cont_year < 1998 then 'early' else 'late' end s from registry)""")
def binary_order(spark, sf):
    frame = stored_registry(spark, sf).withColumn("status", F.when(F.col("cont_year") < 1998, "early").otherwise("late"))
    return p.codebook_frame(frame, ["bin_lowbal", "status"], p.DeclaredTypes(positive={"status": "early"}))


@query("d8_encode", WITH_ENCODED + "\nselect * from encoded")
def encode(spark, sf):
    return encoded(spark, sf)


@query("d8_unknown_labels", WITH_REGISTRY + "\nselect 'ord_priority' feature, ord_priority label, count(*) n from registry where ord_priority in ('1-URGENT','5-LOW') group by 2")
def unknown_labels(spark, sf):
    narrow = p.Codebook((base.Variable("ord_priority", "ordinal", tuple(base.PRIORITIES[1:4])),))
    return p.unknown_labels(stored_registry(spark, sf), narrow)


@query("d9_decode", WITH_REGISTRY + "\nselect cohort, recordid, nom_segment, ord_priority, bin_lowbal, cast(nom_region as varchar) nom_region from registry")
def decode(spark, sf):
    return p.decode(encoded(spark, sf), CODEBOOK.subset(LABELLED), KEYS)


@query("d10_kind_counts", WITH_CELLS + """
select cohort, kind, count(*) n_features from (select cohort, feature, kind from cells group by 1,2,3 having count(value) > 0) group by 1,2""")
def kind_counts(spark, sf):
    return p.kind_counts(p.column_profile(encoded(spark, sf), CODEBOOK.names), CODEBOOK)


@query("d11_field_presence", WITH_REGISTRY + """,
seen as (select cohort, case when cohort = 'A' then qty07 end only_a, case when cohort = 'B' then cont_bal end only_b, cont_price shared from registry),
long as (select cohort, 'only_a' feature, only_a v from seen union all select cohort, 'only_b', only_b from seen union all select cohort, 'shared', shared from seen),
flags as (select feature, bool_or(cohort = 'A' and v is not null) in_A, bool_or(cohort = 'B' and v is not null) in_B from long group by 1)
select feature, in_A, in_B, case when in_A and in_B then 'all' when in_A then 'A' else 'B' end seen_in, feature in ('shared','only_a') analysed from flags""")
def field_presence(spark, sf):
    frame = stored_registry(spark, sf).select(
        "cohort", F.when(F.col("cohort") == "A", F.col("qty07")).alias("only_a"),
        F.when(F.col("cohort") == "B", F.col("cont_bal")).alias("only_b"), F.col("cont_price").alias("shared"),
    )
    return p.field_presence(p.column_profile(frame, ["only_a", "only_b", "shared"]), COHORTS, ["shared", "only_a"])


FIELD_GROUPS = {f: ("money" if f in ("cont_price", "cont_bal") else "lines" if f.startswith(("qty", "cnt")) else "labels") for f in FIELDS if f != "cont_year"}


@query("d12_group_shares", WITH_TEXT + """,
per as (select feature, count(label) n_observed, case when feature in ('cont_price','cont_bal') then 'money' when feature like 'qty%' or feature like 'cnt%' then 'lines'
  when feature = 'cont_year' then 'other' else 'labels' end field_group from text_cells group by 1)
select field_group, count(*) n_features, cast(sum(n_observed) as bigint) n_observed, round(count(*) / sum(count(*)) over (), 6) share from per group by 1""")
def group_shares(spark, sf):
    return rounded(p.group_shares(p.column_profile(stored_registry(spark, sf), FIELDS), FIELD_GROUPS), "share")


@query("d13_median_ratio", WITH_CELLS + """,
med as (select feature, quantile_cont(value, 0.5) filter (where cohort = 'A') a, quantile_cont(value, 0.5) filter (where cohort = 'B') b
  from cells where kind in ('continuous','count') group by 1)
select feature, round(a,6) median_first, round(b,6) median_second, round(a / nullif(b, 0), 6) ratio, a / nullif(b, 0) between 0.5 and 2.0 in_band from med""")
def median_ratio(spark, sf):
    kinds = {k: v for k, v in CODEBOOK.kinds.items() if v in ("continuous", "count")}
    cells = to_cells(encoded(spark, sf), KEYS, kinds)
    return rounded(p.median_ratio_check(cells, "A", "B", max_groups=GROUPS), "median_first", "median_second", "ratio")


# -- E: encodings -----------------------------------------------------------


@query("e1_fit_canonical", WITH_CANONICAL + "\nselect cohort, design, alpha, feature, round(mean,6) mean, round(scale,6) scale, degenerate from scaler")
def fit_canonical(spark, sf):
    return rounded(e.fit_canonical(masked_cells(spark, sf), UNIT, value="masked"), "mean", "scale")


def _cohort_cells(spark, sf):
    return to_cells(encoded(spark, sf), KEYS, CODEBOOK.kinds)


WITH_ZSCORE = WITH_CELLS + """,
sc as (select cohort, feature, avg(value) mean, stddev_pop(value) scale from cells where kind in ('continuous','count') group by 1,2),
z as (select c.*, case when kind in ('continuous','count') then (value - mean) / scale else value end zvalue from cells c left join sc using (cohort, feature))"""


@query("e2_apply_canonical", WITH_ZSCORE + "\nselect cohort, recordid, feature, kind, round(zvalue,6) as value from z")
def apply_canonical(spark, sf):
    cells = _cohort_cells(spark, sf)
    scaler = e.fit_canonical(cells, ["cohort"])
    return rounded(e.apply_canonical(cells, scaler, ["cohort"], rows=GROUPS), "value")


@query("e3_invert_canonical", WITH_CELLS + "\nselect cohort, recordid, feature, kind, round(value,4) as value from cells")
def invert_canonical(spark, sf):
    cells = _cohort_cells(spark, sf)
    scaler = e.fit_canonical(cells, ["cohort"])
    there = e.apply_canonical(cells, scaler, ["cohort"], rows=GROUPS)
    return rounded(e.invert_canonical(there, scaler, ["cohort"], rows=GROUPS), "value", digits=4)


HOT = ", ".join(f"cast(nom_segment = {i} as double) nom_segment__{i}" for i in range(5))


@query("e4_one_hot", WITH_ENCODED + f"\nselect cohort, recordid, {HOT} from encoded")
def one_hot(spark, sf):
    return encoded(spark, sf).select(*KEYS, *e.one_hot("nom_segment", CODEBOOK))


@query("e5_unit_interval", WITH_ENCODED + "\nselect cohort, recordid, ord_priority / 4.0 ord_priority from encoded")
def unit_interval(spark, sf):
    return encoded(spark, sf).select(*KEYS, e.unit_interval(F.col("ord_priority"), 5).alias("ord_priority"))


WITH_KNOTS = WITH_CELLS + """,
nk as (select cohort, greatest(2, least(1000, min(n))) k from (select cohort, feature, count(value) n from cells where kind in ('continuous','count') group by 1,2) group by 1),
grid as (select cohort, k, i, i / cast(k - 1 as double) p from nk, range(1000) r(i) where i < k),
sorted as (select cohort, feature, value, row_number() over (partition by cohort, feature order by value) - 1 r, count(*) over (partition by cohort, feature) n
  from cells where kind in ('continuous','count') and value is not null),
knots as (select g.cohort, a.feature, g.k, g.i, a.value + (b.value - a.value) * (g.p * (a.n - 1) - floor(g.p * (a.n - 1))) q
  from grid g join sorted a on a.cohort = g.cohort and a.r = floor(g.p * (a.n - 1))
  join sorted b on b.cohort = a.cohort and b.feature = a.feature and b.r = ceil(g.p * (b.n - 1)))"""


def fitted_quantiles(spark, sf):
    return stored(spark, sf, "quantiles", lambda: e.fit_quantiles(_cohort_cells(spark, sf), ["cohort"], max_groups=GROUPS))


@query("e6_fit_quantiles", WITH_KNOTS + "\nselect cohort, feature, cast(i as int) i, round(q,4) knot from knots")
def fit_quantiles(spark, sf):
    knots = e.fit_quantiles(_cohort_cells(spark, sf), ["cohort"], max_groups=GROUPS)
    return rounded(knots.select("cohort", "feature", F.posexplode("knots").alias("i", "knot")), "knot", digits=4)


WITH_UNIFORM = WITH_KNOTS + """,
kn as (select cohort, feature, any_value(k) k, list(q order by i) q from knots group by 1,2),
placed as (select c.cohort, c.recordid, c.feature, c.value x, q, k, len(list_filter(q, lambda v: v < c.value)) lo, len(list_filter(q, lambda v: v <= c.value)) hi
  from cells c join kn using (cohort, feature) where c.value is not null),
uniform as (select cohort, recordid, feature, q, k, case when x <= q[1] then 0.0 when x >= q[k] then 1.0
  when hi > lo then (lo + hi - 1) / 2.0 / (k - 1) else ((lo - 1) + (x - q[lo]) / (q[lo + 1] - q[lo])) / (k - 1) end u from placed)"""


def _uniform(spark, sf):
    cells = _cohort_cells(spark, sf).filter(F.col("kind").isin("continuous", "count") & F.col("value").isNotNull())
    return e.apply_quantiles(cells, fitted_quantiles(spark, sf), ["cohort"], rows=GROUPS)


@query("e7_to_uniform", WITH_UNIFORM + "\nselect cohort, recordid, feature, round(u,6) as value from uniform")
def to_uniform(spark, sf):
    return rounded(_uniform(spark, sf).drop("kind"), "value")


@query("e8_from_uniform", WITH_UNIFORM + """
select cohort, recordid, feature, round(q[cast(floor(u * (k - 1)) as int) + 1] + (q[least(cast(floor(u * (k - 1)) as int) + 2, k)] - q[cast(floor(u * (k - 1)) as int) + 1]) * (u * (k - 1) - floor(u * (k - 1))), 3) as value from uniform""")
def from_uniform(spark, sf):
    back = e.invert_quantiles(_uniform(spark, sf), fitted_quantiles(spark, sf), ["cohort"], rows=GROUPS)
    return rounded(back.drop("kind"), "value", digits=3)


# A perturbed one-hot block: the largest of hashed scores wins, NULL rows stay NULL.
@query("e9_invert_one_hot", WITH_ENCODED + """,
b as (select cohort, recordid, case when nom_segment is null then null else [cast(recordid as bigint) * 7 % 5, cast(recordid as bigint) * 3 % 5, cast(recordid as bigint) % 5] end v from encoded)
select cohort, recordid, cast(list_position(v, list_max(v)) - 1 as double) code from b""")
def invert_one_hot(spark, sf):
    rid = F.col("recordid").cast("long")
    frame = encoded(spark, sf).select(*KEYS, *[
        F.when(F.col("nom_segment").isNotNull(), rid * m % 5).alias(f"s__{i}") for i, m in enumerate((7, 3, 1))
    ])
    return frame.select(*KEYS, e.invert_one_hot(["s__0", "s__1", "s__2"]).alias("code"))


@query("e10_invert_unit_interval", WITH_ENCODED + "\nselect cohort, recordid, case when cont_price is null then null else least(greatest(round_even(cont_price / 100000.0 * 4, 0), 0.0), 4.0) end code from encoded")
def invert_unit_interval(spark, sf):
    return encoded(spark, sf).select(*KEYS, e.invert_unit_interval(F.col("cont_price") / 100000.0, 5).alias("code"))


def _model_input(spark, sf):
    numeric = _uniform(spark, sf).select(*KEYS, "feature", "value")
    coded = _cohort_cells(spark, sf).filter(~F.col("kind").isin("continuous", "count")).select(*KEYS, "feature", "value")
    return to_wide(numeric.unionByName(coded), KEYS, CODEBOOK.names)


MODEL_COLUMNS = "u.cont_price, u.cont_bal, u.cnt_lines, u.cont_year, bin_lowbal, ord_priority / 4.0 ord_priority, " + ", ".join(
    f"cast({c} = {i} as double) {c}__{i}" for c in ("nom_segment", "nom_region") for i in range(5))


@query("e11_model_space", WITH_UNIFORM + f""",
wide as (select cohort, recordid, {", ".join(f"round(max(case when feature = '{f}' then u end), 6) {f}" for f in ("cont_price", "cont_bal", "cnt_lines", "cont_year"))} from uniform group by 1,2)
select cohort, recordid, {MODEL_COLUMNS} from encoded join wide u using (cohort, recordid)""")
def model_space(spark, sf):
    out = e.model_space(_model_input(spark, sf), KEYS, CODEBOOK)
    return rounded(out, "cont_price", "cont_bal", "cnt_lines", "cont_year")


@query("e12_snap_binary", WITH_ENCODED + "\nselect cohort, recordid, case when cont_bal is null then null else least(greatest(round_even(cont_bal / 4000.0, 0), 0.0), 1.0) end snapped from encoded")
def snap_binary(spark, sf):
    return encoded(spark, sf).select(*KEYS, e.snap_binary(F.col("cont_bal") / 4000.0).alias("snapped"))


@query("e13_snap_levels", WITH_ENCODED + """
select cohort, recordid, case when cont_bal is null then null else least(greatest(ceil(cont_bal / 2000.0 - 0.5), 0.0), 4.0) end code,
  case when cont_bal is null then null else cast(case when abs(cont_bal - 0) <= abs(cont_bal - 1000) then 0.0 when abs(cont_bal - 1000) <= abs(cont_bal - 5000) then 1000.0 else 5000.0 end as double) end as level from encoded""")
def snap_levels(spark, sf):
    from lacuna.functions.columns import nearest_level

    return encoded(spark, sf).select(
        *KEYS, e.snap_code(F.col("cont_bal") / 2000.0, 5).alias("code"),
        nearest_level(F.col("cont_bal"), [0.0, 1000.0, 5000.0]).alias("level"),
    )


@query("e14_back_from_model_space", WITH_ENCODED + "\nselect cohort, recordid, round(cont_bal, 2) cont_bal, nom_segment, ord_priority, bin_lowbal, nom_region from encoded")
def back_from_model_space(spark, sf):
    encoded_units = e.model_space(_model_input(spark, sf), KEYS, CODEBOOK)
    restored = e.from_model_space(encoded_units, KEYS, CODEBOOK)
    # The record's numbers return through the knots; exact where values are knots or between them.
    cells = to_cells(restored, KEYS, {"cont_bal": "continuous"})
    numbers = e.invert_quantiles(cells, fitted_quantiles(spark, sf), ["cohort"], rows=GROUPS)
    return restored.drop("cont_bal").join(
        numbers.select(*KEYS, F.round("value", 2).alias("cont_bal")), KEYS
    ).select(*KEYS, "cont_bal", "nom_segment", "ord_priority", "bin_lowbal", "nom_region")


@query("e15_dense_codes", WITH_REGISTRY + """,
lv as (select nom_segment, row_number() over (order by nom_segment) code from (select distinct nom_segment from registry where nom_segment is not null))
select cohort, recordid, cast(code as double) nom_segment from registry left join lv using (nom_segment)""")
def dense_codes(spark, sf):
    return e.dense_codes(stored_registry(spark, sf).select(*KEYS, "nom_segment"), "nom_segment").select(*KEYS, "nom_segment")


@query("e15_one_hot_observed", WITH_REGISTRY + "\nselect cohort, recordid, cast(cnt_lines = 1 as double) cnt_lines_1, cast(cnt_lines = 2 as double) cnt_lines_2, cast(cnt_lines = 9 as double) cnt_lines_9 from registry")
def one_hot_observed(spark, sf):
    return e.one_hot_observed(stored_registry(spark, sf).select(*KEYS, "cnt_lines"), "cnt_lines", [1, 2, 9])


@query("e16_prepare_unit", WITH_CANONICAL + "\nselect cohort, design, alpha, feature, status, count(*) n, round(sum(truth),4) truth, round(sum(masked),4) masked from canonical group by all")
def prepare_unit(spark, sf):
    cells, _ = e.prepare_units(masked_cells(spark, sf), UNIT, UNIT_ROWS)
    return cells.groupBy(*UNIT, "feature", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("truth"), 4).alias("truth"), F.round(F.sum("masked"), 4).alias("masked")
    )
