"""Paired comparison of arms (J) over blocks derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, stored, table
from catalog.flagship import rounded
from lacuna.operators import fidelity as fid
from lacuna.operators import report, stats
from lacuna.plans.schema import HELD_OUT

ARMS = [f"m{i}" for i in range(1, 8)]
FAMILY = ["cohort", "target_type"]
BLOCKS = ["design", "split_seed"]
SCORES_SQL = """select l_returnflag cohort, case when l_linestatus = 'O' then 'binary' else 'continuous' end target_type,
  cast(year(l_shipdate) as int) design, cast(l_suppkey % 4 as int) split_seed, 'm' || cast(l_linenumber as varchar(3)) arm,
  floor(avg(l_quantity) * 4) / 4.0 + case when l_returnflag = 'A' then max(l_linenumber) * 3.0 else 0.0 end as value
from {lineitem} where not (l_linenumber = 3 and l_suppkey % 4 = 1 and year(l_shipdate) = 1997) group by 1,2,3,4,5"""


def scores(spark, sf):
    return spark.sql(SCORES_SQL, lineitem=table(spark, sf, "lineitem")).filter("arm in ('m1','m2','m3','m4','m5','m6','m7')")





def direction():
    """Binary endpoints are scored upward, continuous ones downward."""
    return F.when(F.col("target_type") == "binary", stats.HIGHER).otherwise(stats.LOWER)


WITH_BLOCKS = f"""with scores as (select * from ({SCORES_SQL.format(lineitem='lineitem')}) where arm in ('m1','m2','m3','m4','m5','m6','m7')),
totals as (select cohort, target_type, count(*) n_blocks_total from (select distinct cohort, target_type, design, split_seed from scores) group by 1,2),
complete as (select * from (select *, count(*) over (partition by cohort, target_type, design, split_seed) k from scores) where k = 7),
ranks as (select *, rank() over (partition by cohort, target_type, design, split_seed order by sk) + (count(*) over (partition by cohort, target_type, design, split_seed, sk) - 1) / 2.0 r,
    count(*) over (partition by cohort, target_type, design, split_seed, sk) t
  from (select *, case when target_type = 'binary' then -value else value end sk from complete)),
per_arm as (select cohort, target_type, arm, avg(r) mean_rank, sum(r) rs, count(*) n, quantile_cont(value, 0.5) med, sum(t * t - 1) ties from ranks group by 1,2,3),
fam as (select cohort, target_type, count(*) k, max(n) n, sum(rs * rs) ss, sum(ties) ties, max(med) - min(med) rng, quantile_cont(abs(med), 0.5) ref from per_arm group by 1,2),
tests as (select *, (12.0 / (n * k * (k + 1.0)) * ss - 3.0 * n * (k + 1.0)) / (1.0 - ties / (n * k * (k * k - 1.0))) chi2, rng / ref * 100.0 spread_pct from fam where n >= 3),
pv as (select *, exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8) p from tests),
hv as (select *, least(1.0, max((m - rn + 1) * p) over (order by p rows unbounded preceding)) p_holm from (
  select *, row_number() over (order by p) rn, count(*) over () m from pv))"""


@query("j2_paired_matrix", WITH_BLOCKS + "\nselect cohort, target_type, design, split_seed, " + ", ".join(f"max(case when arm = '{a}' then value end) {a}" for a in ARMS) + " from complete group by 1,2,3,4")
def paired_matrix(spark, sf):
    return stats.paired_matrix(scores(spark, sf), FAMILY, BLOCKS, ARMS)


@query("j3_block_ranks", WITH_BLOCKS + "\nselect cohort, target_type, design, split_seed, arm, cast(r as double) rank, t ties from ranks")
def block_ranks(spark, sf):
    complete = stats.paired_blocks(scores(spark, sf), FAMILY, BLOCKS, ARMS)
    ranks = stats.block_ranks(complete, [*FAMILY, *BLOCKS], direction())
    return ranks.select(*FAMILY, *BLOCKS, "arm", "rank", "ties")


def tests(spark, sf, **options):
    return stats.omnibus(scores(spark, sf), FAMILY, BLOCKS, ARMS, direction(), **options)


@query("j4_friedman", WITH_BLOCKS + """
select cohort, target_type, k n_arms, n n_complete_blocks, n_blocks_total, round(chi2,6) chi2, round(p,8) p_value,
  (select arm from per_arm a where a.cohort = pv.cohort and a.target_type = pv.target_type order by mean_rank, arm limit 1) best_mean_rank_arm
from pv join totals using (cohort, target_type)""")
def friedman(spark, sf):
    out = tests(spark, sf).filter("status = 'ok'")
    out = rounded(rounded(out, "chi2"), "p_value", digits=8)
    return out.select(*FAMILY, "n_arms", "n_complete_blocks", "n_blocks_total", "chi2", "p_value", "best_mean_rank_arm")


@query("j5_effect_size", WITH_BLOCKS + "\nselect cohort, target_type, round(spread_pct,6) spread_pct from tests")
def effect_size(spark, sf):
    return rounded(tests(spark, sf).filter("status = 'ok'").select(*FAMILY, "spread_pct"), "spread_pct")


WITH_PAIRS = WITH_BLOCKS + """,
pairs as (select a.cohort, a.target_type, a.arm arm_a, b.arm arm_b, a.value a, b.value b, a.value - b.value diff from complete a join complete b
  on a.cohort = b.cohort and a.target_type = b.target_type and a.design = b.design and a.split_seed = b.split_seed and a.arm < b.arm),
signed as (select *, rank() over (partition by cohort, target_type, arm_a, arm_b order by abs(diff)) + (count(*) over (partition by cohort, target_type, arm_a, arm_b, abs(diff)) - 1) / 2.0 r
  from pairs where diff <> 0),
w as (select cohort, target_type, arm_a, arm_b, least(sum(case when diff > 0 then r else 0 end), sum(case when diff < 0 then r else 0 end)) w from signed group by 1,2,3,4),
base as (select cohort, target_type, arm_a, arm_b, count(*) n_complete_blocks, cast(sum(cast(diff <> 0 as int)) as bigint) n_nonzero_differences,
  cast(sum(case when target_type = 'binary' then cast(diff > 0 as int) else cast(diff < 0 as int) end) as bigint) n_blocks_favouring_a,
  quantile_cont(a, 0.5) median_a, quantile_cont(b, 0.5) median_b, quantile_cont(diff, 0.5) delta from pairs group by 1,2,3,4)"""


@query("j6_pairwise_wilcoxon", WITH_PAIRS + """
select cohort, target_type, arm_a, arm_b, n_complete_blocks, n_nonzero_differences, n_blocks_favouring_a, median_a, median_b, delta median_diff_a_minus_b,
  case when delta = 0 then null when (target_type = 'binary') = (delta > 0) then arm_a else arm_b end better_arm, cast(w as double) wilcoxon_statistic
from base left join w using (cohort, target_type, arm_a, arm_b)""")
def pairwise(spark, sf):
    complete = stats.paired_blocks(scores(spark, sf), FAMILY, BLOCKS, ARMS)
    out = stats.pairwise_wilcoxon(complete, FAMILY, BLOCKS, direction())
    return out.drop("tie_term", "worse_arm")


# The p of the signed-rank statistic: the number of sign patterns with a sum of ranks up to w where there are
# no ties and no zeros (counts[r][t]: subsets of 1..r with sum t), else the normal tail; erf is its series in
# positive terms.
WITH_SIGNED_P = WITH_PAIRS.replace("with scores", "with recursive scores", 1) + """,
counts as (
  select 0 as r, list_transform(range(0, 1276), lambda t: case when t = 0 then 1::bigint else 0::bigint end) as c
  union all select r + 1, list_transform(range(0, 1276), lambda t: c[t + 1] + case when t > r then c[t - r] else 0 end) from counts where r < 50),
tied as (select cohort, target_type, arm_a, arm_b, sum(t * t * t - t) as tie_term from (
  select cohort, target_type, arm_a, arm_b, cast(count(*) as double) as t from signed group by cohort, target_type, arm_a, arm_b, abs(diff)) group by all),
stat as (select b.*, w.w, coalesce(tie_term, 0.0) as tie_term, cast(n_nonzero_differences as double) as n,
    n_nonzero_differences <= 50 and coalesce(tie_term, 0.0) = 0 and n_complete_blocks = n_nonzero_differences as exact
  from base b left join w using (cohort, target_type, arm_a, arm_b) left join tied using (cohort, target_type, arm_a, arm_b)),
tail as (select *, abs(w - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0) / sqrt(2.0) as x from stat),
signed_p as (select t.*, case when w is null or n < 1 then null
    when exact then least(1.0, 2.0 * list_sum(c[1:cast(floor(w) as int) + 1]) / pow(2.0, n))
    when x = 0 or x is null or isnan(x) then 1.0
    else 1.0 - exp(-x * x) * (select sum(exp((2 * k + 1) * ln(x) - lgamma(k + 1.5))) from range(0, 150) s(k)) end as p
  from tail t left join counts on counts.r = t.n_nonzero_differences),
adjusted as (select *, least(1.0, max((m - rn + 1) * p) over (partition by cohort, target_type order by p, rn rows unbounded preceding)) as p_holm
  from (select *, row_number() over (partition by cohort, target_type order by p) as rn, count(*) over (partition by cohort, target_type) as m from signed_p where p is not null))"""


@query("j6_pairwise_p", WITH_SIGNED_P + """
select cohort, target_type, arm_a, arm_b, cast(w as double) wilcoxon_statistic, round(p, 7) p_value, round(p_holm, 7) p_holm from adjusted""")
def pairwise_p(spark, sf):
    complete = stats.paired_blocks(scores(spark, sf), FAMILY, BLOCKS, ARMS)
    pairs = stats.with_signed_rank_p(stats.pairwise_wilcoxon(complete, FAMILY, BLOCKS, direction()))
    out = stats.holm(pairs, FAMILY).select(*FAMILY, "arm_a", "arm_b", "wilcoxon_statistic", "p_value", "p_holm")
    return rounded(out, "p_value", "p_holm", digits=7)


@query("j7_holm", WITH_BLOCKS + "\nselect cohort, target_type, round(p,8) p_value, round(p_holm,8) p_holm from hv")
def holm(spark, sf):
    out = stats.holm(tests(spark, sf).filter("status = 'ok'").select(*FAMILY, "p_value"), [])
    return rounded(out, "p_value", "p_holm", digits=8)


@query("j8_compare_arms", WITH_SIGNED_P + """
select cohort, target_type, status, reject, case when reject then n_tested else 0 end n_pairwise_tested, case when reject then n_significant else 0 end n_pairwise_significant
from (select cohort, target_type, 'ok' as status, p < 0.05 as reject from pv) join (
  select cohort, target_type, count(*) n_tested, count(*) filter (where p_holm < 0.05) n_significant from adjusted group by 1, 2) using (cohort, target_type)""")
def compare_arms(spark, sf):
    found, pairs = stats.compare_arms(scores(spark, sf), FAMILY, BLOCKS, ARMS, direction())
    return stats.pairwise_counts(found, pairs, FAMILY).select(
        *FAMILY, "status", "reject", "n_pairwise_tested", "n_pairwise_significant"
    )


@query("j9_ranked_families", WITH_BLOCKS + """,
o as (select *, row_number() over (partition by cohort, target_type order by mean_rank, arm) pos from per_arm)
select h.cohort, h.target_type, h.n n_complete_blocks, round(chi2,6) chi2, round(p_holm,8) p_holm, p_holm < 0.05 reject,
  a.arm rank1, round(a.mean_rank,6) rank1_mean_rank, b.arm rank2, z.arm rank_last, round(z.mean_rank - a.mean_rank,6) rank_spread
from hv h join o a on a.cohort=h.cohort and a.target_type=h.target_type and a.pos=1 join o b on b.cohort=h.cohort and b.target_type=h.target_type and b.pos=2
join o z on z.cohort=h.cohort and z.target_type=h.target_type and z.pos=7""")
def ranked_families(spark, sf):
    out = stats.ranking_ends(tests(spark, sf, holm_over=[]).filter("status = 'ok'"))
    out = rounded(rounded(out, "chi2", "rank1_mean_rank", "rank_spread"), "p_holm", digits=8)
    return out.select(*FAMILY, "n_complete_blocks", "chi2", "p_holm", "reject", "rank1", "rank1_mean_rank", "rank2", "rank_last", "rank_spread")


# Fidelity ranking: three arms (both members and mean/mode) over unit x feature blocks.
def fidelity_arms(spark, sf):
    from catalog.arms import member
    from catalog.flagship import mean_mode_cells

    # The arms stand beside each other, so that the cells are read once for all of them.
    cells = mean_mode_cells(spark, sf)
    arms = F.explode(F.array(*[
        F.struct(F.lit(name).alias("method"), imputed.alias("imputed"))
        for name, imputed in (("mean", F.col("imputed")), ("one", member(0)), ("two", member(1)))
    ]))
    held = cells.filter(F.col("status") == HELD_OUT).withColumn("_arm", arms)
    beside = held.withColumns({"method": F.col("_arm.method"), "imputed": F.col("_arm.imputed")}).drop("_arm")
    return stored(spark, sf, "three_arms", lambda: fid.reported(fid.fidelity(beside)))


def _three_arm_sql():
    from catalog.arms import SCORE_CTES, WITH_MEMBERS
    from catalog.flagship import WITH_MEAN

    mean_ctes = WITH_MEAN[WITH_MEAN.index("\nmean0 as"):].replace("\nimputed as (", "\nmean_imputed as (")
    return WITH_MEMBERS + "," + mean_ctes + """,
imputed as (select cohort, recordid, feature, kind, design, alpha, status, truth, masked, imputed, case when seed = 0 then 'one' else 'two' end as method from members
  union all select cohort, recordid, feature, kind, design, alpha, status, truth, masked, imputed, 'mean' from mean_imputed),""" + SCORE_CTES + """,
rep as (select cohort, design, alpha, method arm, feature, value, metric = 'rmse' is_rmse from scores where metric in ('rmse','balanced_acc') and value is not null),
comp as (select * from (select *, count(*) over (partition by cohort, design, alpha, feature) k from rep) where k = 3),
rk as (select *, rank() over w + (count(*) over (partition by cohort, design, alpha, feature, sk) - 1) / 2.0 r from (
  select *, round(case when is_rmse then value else -value end, 9) sk from comp) window w as (partition by cohort, design, alpha, feature order by sk))
select cohort, case when is_rmse then 'Continuous' else 'Categorical' end variable_type, arm, count(*) n_complete_blocks, round(avg(r),6) mean_rank from rk group by all"""


@query("j10_fidelity_ranking", _three_arm_sql())
def fidelity_ranking(spark, sf):
    values = fidelity_arms(spark, sf).withColumn("value", F.round("value", 9)).withColumnRenamed("method", "arm")
    family, blocks = ["cohort", "variable_type"], ["simulation", "feature"]
    way = F.when(F.col("variable_type") == "Continuous", stats.LOWER).otherwise(stats.HIGHER)
    complete = stats.paired_blocks(values, family, blocks, ["mean", "one", "two"])
    ranks = stats.block_ranks(complete, [*family, *blocks], way)
    return rounded(stats.arm_summary(ranks, family).select(*family, "arm", "n_complete_blocks", "mean_rank"), "mean_rank")


@query("j10_fidelity_omnibus", _three_arm_sql()[:_three_arm_sql().rindex("\nselect cohort")] + """,
tied as (select *, count(*) over (partition by cohort, design, alpha, feature, sk) t from rk),
pa as (select cohort, is_rmse, arm, sum(r) rs, count(*) n, sum(t * t - 1) ties from tied group by 1, 2, 3),
fam as (select cohort, is_rmse, count(*) k, max(n) n, sum(rs * rs) ss, sum(ties) ties, (max(rs) - min(rs)) / max(n) spread from pa group by 1, 2),
t as (select *, (12.0 / (n * k * (k + 1.0)) * ss - 3.0 * n * (k + 1.0)) / (1.0 - ties / (n * k * (k * k - 1.0))) chi2 from fam where n >= 3)
select cohort, case when is_rmse then 'Continuous' else 'Categorical' end variable_type, n n_complete_blocks, round(chi2, 6) chi2, round(exp(-chi2 / 2), 8) p_value, round(spread, 6) rank_spread from t""")
def fidelity_omnibus(spark, sf):
    values = fidelity_arms(spark, sf).withColumn("value", F.round("value", 9)).withColumnRenamed("method", "arm")
    way = F.when(F.col("variable_type") == "Continuous", stats.LOWER).otherwise(stats.HIGHER)
    found = stats.omnibus(values, ["cohort", "variable_type"], ["simulation", "feature"], ["mean", "one", "two"], way).filter("status = 'ok'")
    out = stats.ranking_ends(found).select("cohort", "variable_type", "n_complete_blocks", "chi2", "p_value", "rank_spread")
    return rounded(rounded(out, "chi2", "rank_spread"), "p_value", digits=8)


# Per endpoint: three endpoints, blocks of design x intensity x split; Holm over all of cohort x endpoint.
TARGETS_SQL = """select l_returnflag cohort, 'y' || cast(l_partkey % 3 as varchar(3)) target, cast(year(l_shipdate) as int) design, cast(l_suppkey % 2 as int) intensity,
  cast(l_suppkey % 6 as int) split_seed, 'm' || cast(l_linenumber as varchar(3)) arm, floor(avg(l_quantity) * 4) / 4.0 as value
from {lineitem} where l_linenumber <= 7 group by 1,2,3,4,5,6"""
WITH_TARGETS = WITH_BLOCKS[WITH_BLOCKS.index("totals as"):].replace("target_type = 'binary'", "target <> 'y2'").replace("target_type", "target").replace("split_seed", "intensity, split_seed")


@query("j11_per_target", f"with scores as ({TARGETS_SQL.format(lineitem='lineitem')}), " + WITH_TARGETS + """
select cohort, target, n n_complete_blocks, round(chi2,6) chi2, round(p_holm,8) p_holm, p_holm < 0.05 reject from hv""")
def per_target(spark, sf):
    found = spark.sql(TARGETS_SQL, lineitem=table(spark, sf, "lineitem"))
    way = F.when(F.col("target") != "y2", stats.HIGHER).otherwise(stats.LOWER)
    out = stats.omnibus(found, ["cohort", "target"], ["design", "intensity", "split_seed"], ARMS, way, holm_over=[]).filter("status = 'ok'")
    return rounded(rounded(out.select("cohort", "target", "n_complete_blocks", "chi2", "p_holm", "reject"), "chi2"), "p_holm", digits=8)


@query("j12_positions", WITH_BLOCKS + """
select cohort, target_type, arm, round(mean_rank,6) mean_rank, cast(pos as int) position, p_holm < 0.05 and pos <= 3 top from (
  select *, rank() over (partition by cohort, target_type order by mean_rank) pos from per_arm) join hv using (cohort, target_type)""")
def positions(spark, sf):
    found = tests(spark, sf, holm_over=[]).filter("status = 'ok'")
    return rounded(stats.ranking(found, FAMILY), "mean_rank")


@query("k14_mean_rank_table", WITH_BLOCKS + "\nselect cohort, target_type, round(any_value(chi2),6) chi2, " + ", ".join(
    f"round(max(case when arm = '{a}' then mean_rank end),6) {a}" for a in ARMS) + " from per_arm join tests using (cohort, target_type) group by 1,2")
def mean_rank_table(spark, sf):
    out = report.mean_rank_table(tests(spark, sf).filter("status = 'ok'"), FAMILY, ARMS)
    return rounded(out, "chi2", *ARMS)


@query("k14_blocks_won", WITH_SIGNED_P + """
select cohort, target_type, case when (target_type = 'binary') = (delta > 0) then arm_a else arm_b end better_arm, case when (target_type = 'binary') = (delta > 0) then arm_b else arm_a end worse_arm,
  case when (target_type = 'binary') = (delta > 0) then n_blocks_favouring_a else n_nonzero_differences - n_blocks_favouring_a end blocks_won, n_complete_blocks, delta median_diff_a_minus_b,
  round(p_holm, 7) p_holm
from adjusted semi join (select * from pv where p < 0.05) using (cohort, target_type) where p_holm < 0.05 and delta <> 0""")
def blocks_won(spark, sf):
    # The pairs that survive Holm in the families whose omnibus rejects.
    _, pairs = stats.compare_arms(scores(spark, sf), FAMILY, BLOCKS, ARMS, direction())
    return rounded(report.surviving_pairs(pairs.filter("better_arm is not null"), FAMILY), "p_holm", digits=7)


@query("j9_surviving_pairs", WITH_SIGNED_P + """
select cohort, target_type, case when (target_type = 'binary') = (delta > 0) then arm_a else arm_b end better_arm, case when (target_type = 'binary') = (delta > 0) then arm_b else arm_a end worse_arm,
  case when (target_type = 'binary') = (delta > 0) then n_blocks_favouring_a else n_nonzero_differences - n_blocks_favouring_a end blocks_won, n_complete_blocks, delta median_diff_a_minus_b,
  round(p_holm, 7) p_holm
from adjusted semi join (select * from hv where p_holm < 0.05) using (cohort, target_type) where p_holm < 0.05 and delta <> 0""")
def surviving_pairs(spark, sf):
    # Holm over the families' omnibus tests first, then over the pairs of those that it leaves.
    _, pairs = stats.compare_arms(scores(spark, sf), FAMILY, BLOCKS, ARMS, direction(), correct_families=True)
    return rounded(report.surviving_pairs(pairs.filter("better_arm is not null"), FAMILY), "p_holm", digits=7)
