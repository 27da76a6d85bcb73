"""Missingness injection (F)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import base
from catalog.base import CODEBOOK, COHORTS, KEYS, MAR_STUDY, STUDY, encoded, query, sql_uniform, stored, table
from catalog.flagship import masked_cells, rounded
from lacuna.functions.columns import hash_uniform
from lacuna.functions.frames import local_frame, to_cells
from lacuna.operators import mask
from lacuna.operators.profile import column_profile

GROUPS = STUDY.groups()


def _cells(spark, sf):
    return to_cells(encoded(spark, sf), KEYS, CODEBOOK.kinds)


@query("f1_unit_seed", """select cohort, design, cast(('0x' || substr(sha256('2025|' || cohort || '|' || design),1,8))::BIGINT as bigint) seed
from (select distinct 'c' || cast(n_regionkey as varchar) cohort, n_name design from nation)""")
def unit_seed(spark, sf):
    pairs = table(spark, sf, "nation").select(
        F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("cohort"), F.col("n_name").alias("design")
    ).distinct()
    return pairs.withColumn("seed", mask.unit_seed_column(2025, F.col("cohort"), F.col("design")))


@query("f2_budgets", base.WITH_BUDGET + "\nselect * from budget")
def budgets(spark, sf):
    profile = column_profile(encoded(spark, sf), CODEBOOK.names)
    return mask.budgets(profile, STUDY.masks.alphas)


@query("f3_uniform_draw", base.WITH_CELLS + f"\nselect cohort, recordid, feature, round({sql_uniform(base.SEED_SQL.replace('design', chr(39) + 'mcar' + chr(39)), 'feature', 'recordid')}, 9) u from cells where value is not null")
def uniform_draw(spark, sf):
    cells = _cells(spark, sf).filter("value is not null")
    seed = mask.unit_seed_column(2025, F.col("cohort"), F.lit("mcar"))
    return cells.select(*KEYS, "feature", F.round(hash_uniform(seed, F.col("feature"), F.col("recordid")), 9).alias("u"))


# Columns complete enough to drive the MAR design in every cohort.
DRIVERS = ["cnt_lines", "cont_year", "nom_region", "ord_priority"]
MAR_TARGETS = CODEBOOK.names
DRIVER_SHARE = 0.94


@query("f4_driver_list", base.WITH_CELLS + f"""
select cohort, feature from (select cohort, feature, count(value) / cast(count(*) as double) s from cells group by 1,2) where s >= {DRIVER_SHARE}""")
def driver_list(spark, sf):
    profile = column_profile(encoded(spark, sf), CODEBOOK.names)
    settings = replace(MAR_STUDY.masks, driver_min_observed=DRIVER_SHARE)
    found = mask.mar_drivers(profile, settings, CODEBOOK.names)
    return local_frame(spark, [(c, d) for c, names in found.items() for d in names], "cohort string, feature string")


DRIVER_STATS = ", ".join(
    f"avg({d}) m_{d}, stddev_pop({d}) * sqrt(count({d}) / cast(count(*) as double)) s_{d}" for d in DRIVERS)
DRIVER_Z = ", ".join(f"(coalesce({d}, m_{d}) - m_{d}) / s_{d} z_{d}" for d in DRIVERS)
WITH_DRIVERS = base.WITH_ENCODED + f""",
dstats as (select cohort, {DRIVER_STATS} from encoded group by 1),
zs as (select e.*, {DRIVER_Z} from encoded e join dstats using (cohort))"""


@query("f4_driver_scores", WITH_DRIVERS + "\nselect cohort, recordid, " + ", ".join(f"round(z_{d},6) z_{d}" for d in DRIVERS) + " from zs")
def driver_scores(spark, sf):
    scored = mask.driver_scores(encoded(spark, sf), DRIVERS, len(COHORTS))
    return rounded(scored.select(*KEYS, *[f"z_{d}" for d in DRIVERS]), *[f"z_{d}" for d in DRIVERS])


def _sql_weight(target):
    def of(cohort):
        betas = mask.mar_betas(MAR_STUDY.masks, cohort, target, DRIVERS)
        logit = " + ".join(f"z_{d} * cast({b!r} as double)" for d, b in betas.items())
        return f"1.0 / (1.0 + exp(-least(greatest(3.0 * ({logit}), -10.0), 10.0)))"

    return "case cohort " + " ".join(f"when '{c}' then {of(c)}" for c in COHORTS) + " end"


@query("f5_mar_weights", WITH_DRIVERS + "\nselect cohort, recordid, " + ", ".join(f"round({_sql_weight(t)}, 6) w_{t}" for t in MAR_TARGETS) + " from zs")
def mar_weights(spark, sf):
    scored = mask.driver_scores(encoded(spark, sf), DRIVERS, len(COHORTS))
    return scored.select(*KEYS, *[F.round(mask.mar_weight(MAR_STUDY.masks, t, dict.fromkeys(COHORTS, DRIVERS)), 6).alias(f"w_{t}") for t in MAR_TARGETS])


@query("f6_tail_rules", base.WITH_WEIGHTS + "\nselect cohort, feature, round(low,6) low, round(high,6) high, n_levels, branch from rules")
def tail_rules(spark, sf):
    return rounded(mask.tail_profile(mask.level_counts(_cells(spark, sf)), STUDY), "low", "high")


@query("f7_rare_levels", base.WITH_WEIGHTS + "\nselect cohort, feature, value from rare where feature in (select feature from rules where branch = 'rare')")
def rare_levels(spark, sf):
    levels = mask.level_counts(_cells(spark, sf))
    rare = mask.rare_levels(levels, GROUPS)
    few = mask.tail_profile(levels, STUDY).filter("branch = 'rare'").select("cohort", "feature")
    return rare.join(F.broadcast(few), ["cohort", "feature"], "left_semi")


@query("f6_mnar_weights", base.WITH_WEIGHTS + "\nselect cohort, recordid, feature, weight from weights where design = 'mnar' and value is not null")
def mnar_weights(spark, sf):
    cells = mask.weighted_cells(encoded(spark, sf), STUDY.with_masks(designs=("mnar",)), CODEBOOK.names)
    return cells.filter("value is not null").select(*KEYS, "feature", "weight")


@query("f8_weighted_draw", base.WITH_MASKS + """
select cohort, feature, design, alpha, count(*) n_drawn from drawn join budget using (cohort, feature) where rn <= budget group by all""")
def weighted_draw(spark, sf):
    hidden = masked_cells(spark, sf).filter("status = 2")
    return hidden.groupBy("cohort", "feature", "design", "alpha").agg(
        F.count(F.lit(1)).alias("n_drawn")
    )


@query("f9_nested_mask", base.WITH_MASKS + "\nselect cohort, recordid, feature, design, alpha, cast(status as int) status, round(masked,6) masked from masks where status <> 0")
def nested_mask(spark, sf):
    cells = masked_cells(spark, sf).filter("status <> 0")
    return cells.select(*KEYS, "feature", "design", "alpha", F.col("status").cast("int").alias("status"), F.round("masked", 6).alias("masked"))


MAR_BRANCHES = " ".join(f"when '{v}' then {_sql_weight(v)}" for v in CODEBOOK.names)
MAR_VALUES = " ".join(f"when '{v}' then {v}" for v in CODEBOOK.names)


@query("f9_mar_mask", base.WITH_BUDGET + f""",
dstats as (select cohort, {DRIVER_STATS} from encoded group by 1),
zs as (select e.*, {DRIVER_Z} from encoded e join dstats using (cohort)),
mar as (select cohort, recordid, feature, 'mar' design, case feature {MAR_BRANCHES} end weight, case feature {MAR_VALUES} end v
  from zs cross join (select distinct feature from budget)),
drawn as (select cohort, recordid, feature, row_number() over (partition by cohort, feature
    order by -ln({sql_uniform(base.SEED_SQL, 'feature', 'recordid')}) / weight, recordid) rn from mar where v is not null)
select cohort, recordid, feature, alpha from drawn join budget using (cohort, feature) where rn <= budget""")
def mar_mask(spark, sf):
    study = MAR_STUDY.with_masks(driver_min_observed=DRIVER_SHARE)
    matrix = stored(spark, sf, "mar_masked", lambda: mask.hidden(encoded(spark, sf), study))
    return mask.masked_cells(matrix, study).filter("status = 2").select(*KEYS, "feature", "alpha")


@query("f10_manifest", base.WITH_MASKS + """
select cohort, design, alpha, count(distinct recordid) n_rows, count(distinct feature) n_columns, cast(sum(cast(status = 1 as int)) as bigint) n_missing,
  cast(sum(cast(status = 2 as int)) as bigint) n_held_out, cast(('0x' || substr(sha256('2025|' || cohort || '|' || design),1,8))::BIGINT as bigint) seed
from masks group by cohort, design, alpha""")
def manifest(spark, sf):
    return mask.manifest(masked_cells(spark, sf), STUDY)
