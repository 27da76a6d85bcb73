"""Sources, sinks, names, joins and value rewrites (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, WITH_REGISTRY, query, registry, scratch, stored, table
from lacuna.operators import harmonise as h
from lacuna.sources import files

# A messy export derived from the registry: odd names, padded text, tokens,
# variant labels, sentinels and impossible values.
RAW_SPARK = """select cohort, concat(' ', recordid, ' ') as `Record ID`,
  case when cast(recordid as bigint) % 97 = 0 then 5000.0 when cast(recordid as bigint) % 97 = 1 then -1.0 else cont_price end as `Cont Price (USD)`,
  case when cast(recordid as bigint) % 11 = 0 then 'Unknown' when cast(recordid as bigint) % 11 = 1 then ' Not documented '
       when cast(recordid as bigint) % 11 = 2 then '' else concat(' ', nom_segment, ' ') end as `Nom/Segment`,
  case when bin_lowbal = 'Yes' and cast(recordid as bigint) % 5 = 0 then 'Yes, planned' else bin_lowbal end as `Low Bal`,
  cast(cnt_lines as double) as `Cnt Lines`, ord_priority as `Ord Priority`,
  cast(qty01 as varchar(10)) qty01, cast(qty02 as varchar(10)) qty02, cast(qty03 as varchar(10)) qty03, cast(qty04 as varchar(10)) qty04,
  cast(qty05 as varchar(10)) qty05, cast(qty06 as varchar(10)) qty06, cast(qty07 as varchar(10)) qty07,
  cast(nom_region as varchar(10)) as `or time`
from {registry}"""

RAW_SQL = (
    RAW_SPARK.replace("`Record ID`", '"Record ID"').replace("`Cont Price (USD)`", '"Cont Price (USD)"')
    .replace("`Nom/Segment`", '"Nom/Segment"').replace("`Low Bal`", '"Low Bal"').replace("`Cnt Lines`", '"Cnt Lines"')
    .replace("`Ord Priority`", '"Ord Priority"').replace("`or time`", '"or time"')
    .replace("concat(' ', nom_segment, ' ')", "' ' || nom_segment || ' '").format(registry="registry")
)
RAW_SPARK = RAW_SPARK.replace("concat(' ', nom_segment, ' ')", "' ' || nom_segment || ' '")

TOKENS = ["Unknown", "Not documented", ""]
ALIASES = {"record_id": "recordid", "cont_price_usd": "cont_price", "nom_segment": "nom_segment_raw", "or_time": "ortime"}
LABELS = [
    {"name": "low_balance", "columns": ["low_bal"], "map": {"Yes, planned": "Yes"}},
    {"name": "segments", "columns": ["nom_segment_raw"], "map": {"BUILDING": "PROPERTY", "FURNITURE": "PROPERTY"}},
]
FILTERS = [{"name": "priority", "column": "ord_priority", "exclude_values": ["4-NOT SPECIFIED"], "keep_null": True}]
STRUCTURAL = [
    {"name": "low_balance_segment", "categorical": ["nom_segment_raw"], "when": {"low_bal": ["No"]}, "fill": "NotApplicable"},
    {"name": "no_lines", "numeric_zero": ["cnt_lines"], "when": {"nom_segment_raw": ["NotApplicable"], "low_bal": ["Yes"]}},
    {"name": "gate_all", "categorical": ["low_bal"], "when": {"ortime": ["0"], "nom_segment_raw": ["PROPERTY"]},
     "when_mode": "all", "fill": "No"},
    {"name": "absent_gate", "categorical": ["low_bal"], "when": {"no_such_column": ["x"]}},
]
INDICES = ["01", "02", "03", "04", "05", "06", "07"]
SPEC = h.HarmoniseSpec(
    aliases=ALIASES, tokens=TOKENS, label_groups=LABELS, row_filters=FILTERS, structural=STRUCTURAL,
    ladder_families=["qty"], ladder_indices=INDICES, bounds={"cont_price": {"min": 0, "max": 400000}},
    sentinels={"cont_price": [5000.0]}, any_of={"any_low": ["low_bal"]},
)


def raw(spark, sf):
    return spark.sql(RAW_SPARK, registry=registry(spark, sf))


def opened(spark, sf):
    return h.apply_column_aliases(h.normalise_column_names(raw(spark, sf)), ALIASES)


WITH_RAW = WITH_REGISTRY + f",\nraw as ({RAW_SQL})"
QTY = ", ".join(f"qty{i}" for i in INDICES)
WITH_OPENED = WITH_RAW + f""",
opened as materialized (select cohort, "Record ID" recordid, "Cont Price (USD)" cont_price, "Nom/Segment" nom_segment_raw,
  "Low Bal" low_bal, "Cnt Lines" cnt_lines, "Ord Priority" ord_priority, {QTY}, "or time" ortime from raw),
trimmed as (select cohort, trim(recordid) recordid, cont_price, trim(nom_segment_raw) nom_segment_raw, trim(low_bal) low_bal,
  cnt_lines, trim(ord_priority) ord_priority, {QTY}, trim(ortime) ortime from opened)"""
TOKEN_LIST = "('Unknown','Not documented','')"
WITH_TOKENS = WITH_OPENED + f""",
tokened as (select * replace (case when nom_segment_raw in {TOKEN_LIST} then null else nom_segment_raw end as nom_segment_raw,
  case when low_bal in {TOKEN_LIST} then null else low_bal end as low_bal) from trimmed),
labelled as (select * replace (case when low_bal = 'Yes, planned' then 'Yes' else low_bal end as low_bal,
  case when nom_segment_raw in ('BUILDING','FURNITURE') then 'PROPERTY' else nom_segment_raw end as nom_segment_raw) from tokened),
filtered as (select * from labelled where ord_priority is null or ord_priority <> '4-NOT SPECIFIED'),
s1 as (select * replace (case when nom_segment_raw is null and low_bal = 'No' then 'NotApplicable' else nom_segment_raw end as nom_segment_raw) from filtered),
s2 as (select * replace (case when cnt_lines is null and (nom_segment_raw = 'NotApplicable' or low_bal = 'Yes') then 0 else cnt_lines end as cnt_lines) from s1),
s3 as (select * replace (case when low_bal is null and ortime = '0' and nom_segment_raw = 'PROPERTY' then 'No' else low_bal end as low_bal) from s2),
rungs as (select *, greatest({", ".join(f"case when qty{i} is not null then {n} else 0 end" for n, i in enumerate(INDICES, 1))}) last_rung from s3),
laddered as (select * exclude (last_rung) replace ({", ".join(f"case when qty{i} is null and {n} > last_rung then 'NotApplicable' else qty{i} end as qty{i}" for n, i in enumerate(INDICES, 1))}) from rungs),
sentinel as (select * replace (case when cont_price = 5000.0 then null else cont_price end as cont_price) from laddered),
harmonised as (select * replace (case when cont_price < 0 or cont_price > 400000 then null else cont_price end as cont_price),
  case when low_bal = 'Yes' then 'Yes' when low_bal is not null then 'No' end any_low from sentinel)"""


# -- A: sources and sinks ---------------------------------------------------


@query("a1_read_csv", "select cast(o_orderkey as varchar) recordid, cast(o_custkey as varchar) as ortime, o_orderstatus from orders")
def read_csv(spark, sf):
    path = scratch(spark)
    export = table(spark, sf, "orders").select(
        F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("recordid"),
        F.col("o_custkey").alias("or time"), "o_orderstatus",
    )
    files.write_csv(export, path)
    return files.read_export(spark, path)


@query("a2_read_parquet", "select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1998-01-01'")
def read_parquet(spark, sf):
    return files.read_matrix(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderdate"]).filter(
        "o_orderdate >= timestamp '1998-01-01'"
    ).drop("o_orderdate")


@query("a4_write_partitioned", WITH_REGISTRY + """
select cohort, case when cont_year % 2 = 0 then 'mcar' else 'mnar' end design, cast(nom_region as int) alpha, count(*) n, round(sum(cont_price),2) total
from registry group by all""")
def write_partitioned(spark, sf):
    path = scratch(spark)
    units = registry(spark, sf).select(
        "cohort", F.when(F.col("cont_year") % 2 == 0, "mcar").otherwise("mnar").alias("design"),
        F.col("nom_region").alias("alpha"), "recordid", "cont_price",
    )
    files.write_units(units, path)
    back = spark.read.parquet(path)
    return back.groupBy("cohort", "design", F.col("alpha").cast("int").alias("alpha")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cont_price"), 2).alias("total")
    )


@query("a5_write_csv", "select cast(c_custkey as varchar) c_custkey, cast(c_nationkey as varchar) c_nationkey, c_mktsegment from customer")
def write_csv(spark, sf):
    path = scratch(spark)
    files.write_csv(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), path)
    return files.read_export(spark, path)


# Nested result records derived from line items: one per (flag, status, quantity band, method).
RECORD_UNITS = """select l_returnflag cohort, case when l_linestatus = 'O' then 'mcar' else 'mnar' end design,
  cast(case when l_quantity > 25 then 0.2 else 0.05 end as double) alpha, case when l_tax > 0.04 then 'mean' else 'knn' end as method,
  case when l_discount > 0.05 then 'rmse' else 'balanced_acc' end metric, 'f' || cast(l_linenumber as varchar(5)) feature,
  round(avg(l_extendedprice), 4) as value from {lineitem} group by 1,2,3,4,5,6"""


@query("a6_read_nested_metrics", RECORD_UNITS.format(lineitem="lineitem"))
def read_nested_metrics(spark, sf):
    flat = spark.sql(RECORD_UNITS, lineitem=table(spark, sf, "lineitem"))
    unit = ["cohort", "design", "alpha", "method"]
    by_metric = flat.groupBy(*unit, "metric").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    records = by_metric.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("metric", "m"))).alias("metrics"))
    path = scratch(spark)
    files.write_report(records, path)
    long = files.explode_metrics(files.read_results(spark, path, files.FIDELITY_SCHEMA))
    return long.select(*unit, "metric", "feature", "value")


RUNS_SQL = """select l_returnflag cohort, case when l_linestatus = 'O' then 'mcar' else 'mnar' end design, 0.05 alpha,
  case when l_tax > 0.04 then 'mean' else 'knn' end as method, 'late' target, l_linenumber seed,
  count(*) n_rows, round(avg(l_discount), 6) roc_auc from {lineitem} group by 1,2,3,4,5,6"""


@query("a6_read_nested_runs", f"""select cohort, design, cast(alpha as double) alpha, method, target, seed,
  cast(row_number() over (partition by cohort, design, method order by seed) as int) split_repeat, roc_auc from ({RUNS_SQL.format(lineitem="lineitem")})""")
def read_nested_runs(spark, sf):
    flat = spark.sql(RUNS_SQL, lineitem=table(spark, sf, "lineitem"))
    unit = ["cohort", "design", "alpha", "method", "target"]
    records = flat.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("seed", "roc_auc"))).alias("runs"))
    path = scratch(spark)
    files.write_report(records, path)
    schema = files.PREDICTION_SCHEMA_HEAD + ", runs array<struct<seed: int, roc_auc: double>>"
    runs = files.explode_runs(files.read_results(spark, path, schema))
    return runs.select(*unit, "seed", "split_repeat", "roc_auc")


@query("a7_write_reports", "select c_mktsegment feature, count(*) n, count(distinct c_nationkey) n_levels from customer group by 1")
def write_reports(spark, sf):
    path = scratch(spark)
    files.write_report(
        table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("feature")).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("n_levels")
        ), path,
    )
    return spark.read.schema("feature string, n bigint, n_levels bigint").json(path)


@query("a8_identity_from_path", """select distinct regexp_extract(url, '^https?://([^/]+)', 1) cohort, 'mcar' design,
  cast(page_id % 2 * 15 + 5 as int) percent, 'mean' as method from pages""")
def identity_from_path(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("c"), F.lit("mcar").alias("d"),
        ((F.col("page_id") % 2 * 15 + 5) / 100.0).alias("a"),
    )
    path = F.concat(F.lit("/results/"), files.unit_tag(F.col("c"), F.col("d"), F.col("a")), F.lit("_mean.csv"))
    return pages.select(files.parse_stem(path).alias("u")).select("u.*").distinct()


DELIVERED = """select case when o_orderkey % 3 = 0 then 'B' else 'A' end cohort, o_orderpriority design, year(o_orderdate) alpha,
  cast(o_orderkey % 2 as int) seed from {orders} where (o_orderkey % 2 = 0 or year(o_orderdate) % 2 = 0)"""


@query("a9_complete_members", f"select cohort, design, cast(alpha as int) alpha from ({DELIVERED.format(orders='orders')}) group by all having count(distinct seed) = 2")
def complete_members(spark, sf):
    members = spark.sql(DELIVERED, orders=table(spark, sf, "orders"))
    return files.complete_units(members, [0, 1]).withColumn("alpha", F.col("alpha").cast("int"))


@query("a10_pending_units", f"""with d as ({DELIVERED.format(orders='orders')}), grid as (select distinct cohort, design, cast(alpha as int) alpha from d)
select * from grid where (cohort, design, alpha) not in (select cohort, design, cast(alpha as int) from d where seed = 1)""")
def pending_units(spark, sf):
    members = spark.sql(DELIVERED, orders=table(spark, sf, "orders")).withColumn("alpha", F.col("alpha").cast("int"))
    unit = files.UNIT
    return files.pending(members.select(*unit).distinct(), members.filter("seed = 1").distinct(), unit)


@query("a11_work_list", """with grid as (select n_name unit, m as method, t as target from nation, (values ('mean'),('knn')) a(m), (values ('y1'),('y2')) b(t))
select * from grid where not (method = 'knn' and target = 'y2' and unit in (select n_name from nation where n_regionkey = 0))""")
def work_list(spark, sf):
    nation = table(spark, sf, "nation")
    methods = spark.createDataFrame([("mean",), ("knn",)], "method string")
    targets = spark.createDataFrame([("y1",), ("y2",)], "target string")
    done = nation.filter("n_regionkey = 0").select(F.col("n_name").alias("unit"), F.lit("knn").alias("method"), F.lit("y2").alias("target"))
    return files.work_list(nation.select(F.col("n_name").alias("unit")), methods, targets, done)


@query("a12_fingerprint", WITH_REGISTRY + """
select cohort, count(*) n_rows, cast(sum(cast(nom_segment is null as int) + cast(bin_lowbal is null as int)) as bigint) n_null,
  cast(sum(('0x' || substr(md5(length(recordid) || ':' || recordid || '|' || coalesce(length(nom_segment) || ':' || nom_segment,'~') || '|' || coalesce(length(bin_lowbal) || ':' || bin_lowbal,'~')),1,12))::BIGINT) as varchar) hash_sum
from registry group by 1""")
def fingerprint(spark, sf):
    frame = registry(spark, sf).select("cohort", "recordid", "nom_segment", "bin_lowbal")
    return files.fingerprint(frame, ["cohort"]).withColumn("hash_sum", F.col("hash_sum").cast("string"))


# -- B: names, guards, joins ------------------------------------------------


@query("b1_normalise_names", WITH_OPENED + "\nselect cohort, recordid as record_id, cont_price as cont_price_usd, nom_segment_raw as nom_segment, low_bal, cnt_lines, ord_priority, " + QTY + ", ortime as or_time from opened")
def normalise_names(spark, sf):
    return h.normalise_column_names(raw(spark, sf))


@query("b2_column_aliases", WITH_OPENED + "\nselect * from opened")
def column_aliases(spark, sf):
    return opened(spark, sf)


@query("b3_shape_guard", """select 'only_in_clean' issue, cast(o_orderkey as varchar) item from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'only_in_other', cast(k as varchar) from (select distinct l_orderkey k from lineitem) where k not in (select o_orderkey from orders)
union all select 'column', 'o_totalprice' union all select 'column', 'n'""")
def shape_guard(spark, sf):
    clean = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    other = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return h.shape_differences(clean, other, ["o_orderkey"])


@query("b4_align_on_id", "select o.o_orderkey, o_custkey, n, q from orders o left join (select l_orderkey, count(*) n, sum(l_quantity) q from lineitem group by 1) on l_orderkey = o_orderkey")
def align_on_id(spark, sf):
    target = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    source = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    return h.align_on_id(target, source, ["n", "q", "absent"], "o_orderkey")


@query("b5_join_targets", WITH_REGISTRY + "\nselect cohort, recordid, cont_price, y_bin, y_cont from registry")
def join_targets(spark, sf):
    frame = stored(spark, sf, "registry", lambda: registry(spark, sf))
    return h.join_targets(
        frame.select(*KEYS, "cont_price"), frame.select(*KEYS, "y_bin", "y_cont"), KEYS
    )


# -- C: value rewrites ------------------------------------------------------


def _apply(frame, rules):
    for rule in rules:
        frame = rule.apply(frame)
    return frame


CHAIN_COLUMNS = ["cohort", "recordid", "cont_price", "nom_segment_raw", "low_bal", "cnt_lines", "ord_priority", *[f"qty{i}" for i in INDICES], "ortime"]


def _until(step):
    """Frame after the named step of the chain."""

    def run(spark, sf):
        frame = h.trim_text(opened(spark, sf))
        stages = [
            ("tokened", lambda f: _apply(f, h.missing_token_rules(f, TOKENS, KEYS))),
            ("labelled", lambda f: _apply(f, h.label_alias_rules(f, LABELS))),
            ("filtered", lambda f: h.apply_row_filters(f, FILTERS)),
            ("s1", lambda f: _apply(f, h.structural_rules(f, STRUCTURAL[:1]))),
            ("s2", lambda f: _apply(f, h.structural_rules(f, STRUCTURAL[1:2]))),
            ("s3", lambda f: _apply(f, h.structural_rules(f, STRUCTURAL[2:]))),
            ("laddered", lambda f: _apply(f, h.ladder_rules(f, ["qty"], INDICES))),
            ("sentinel", lambda f: _apply(f, h.implausible_rules(f, {}, SPEC.sentinels))),
            ("bounded", lambda f: _apply(f, h.implausible_rules(f, SPEC.bounds, {}))),
        ]
        for name, go in stages:
            frame = go(frame)
            if name == step:
                return frame.select(*CHAIN_COLUMNS)
        raise KeyError(step)

    return run


for _name, _step in (
    ("c1_missing_tokens", "tokened"), ("c2_label_aliases", "labelled"), ("c3_row_filters", "filtered"),
    ("c5_structural_na", "s1"), ("c6_structural_zero", "s2"), ("c4_condition_mask", "s3"),
    ("c7_ladder", "laddered"), ("c8_sentinels", "sentinel"),
):
    query(_name, WITH_TOKENS + f"\nselect {', '.join(CHAIN_COLUMNS)} from {_step}")(_until(_step))
query("c9_bounds", WITH_TOKENS + f"\nselect {', '.join(CHAIN_COLUMNS)} from harmonised")(_until("bounded"))


@query("c10_any_of", WITH_REGISTRY + """
select cohort, recordid, case when bin_lowbal = 'Yes' or ord_priority = 'Yes' then 'Yes' when bin_lowbal is null and ord_priority is null then null else 'No' end any_flag,
  case when y_bin = 1 or nom_region = 1 then 1 else 0 end any_code from registry""")
def any_of(spark, sf):
    return registry(spark, sf).select(
        *KEYS, h.any_of(["bin_lowbal", "ord_priority"]).alias("any_flag"), h.any_of(["y_bin", "nom_region"], 1, 0).alias("any_code")
    )


@query("c11_constructed_zero", WITH_REGISTRY + "\nselect cohort, recordid, case when cont_price is null and y_bin = 0 then 0.0 else cont_price end cont_price from registry")
def constructed_zero(spark, sf):
    return h.target_series(registry(spark, sf), KEYS, "cont_price", False, "y_bin")


@query("c12_as_binary", WITH_REGISTRY + """
select cohort, recordid, cast(y_bin as double) shifted, case when cnt_lines is null then null else least(greatest(cast(cnt_lines as double),0.0),1.0) end clipped,
  least(greatest(cast(round_even(nom_region / 2.0, 0) as double),0.0),1.0) halved from registry""")
def as_binary(spark, sf):
    frame = registry(spark, sf).select(
        *KEYS, (F.col("y_bin") + 1).alias("shifted"), F.col("cnt_lines").cast("double").alias("clipped"),
        (F.col("nom_region") / 2.0).alias("halved"),
    )
    return h.as_binary(frame, ["shifted", "clipped", "halved"])


@query("c13_coerce_numeric", WITH_RAW + """
select trim("Record ID") recordid, "Cont Price (USD)" price, try_cast("Nom/Segment" as double) segment, try_cast("or time" as double) region,
  case when "Cnt Lines" = 3 then null else "Cnt Lines" end lines from raw""")
def coerce_numeric(spark, sf):
    frame = raw(spark, sf).select(
        F.col("Record ID").alias("recordid"), F.col("Cont Price (USD)").alias("price"), F.col("Nom/Segment").alias("segment"),
        F.col("or time").alias("region"), F.when(F.col("Cnt Lines") == 3, F.lit(float("inf"))).otherwise(F.col("Cnt Lines")).alias("lines"),
    )
    return h.coerce_features(frame, ["recordid"])


@query("c14_drop_outcomes", WITH_REGISTRY + "\nselect cohort, recordid, nom_segment, nom_region, ord_priority, bin_lowbal, qty01, qty02, qty03, qty04, qty05, qty06, qty07, cnt_lines from registry")
def drop_outcomes(spark, sf):
    return h.drop_outcomes(registry(spark, sf), ["cont", "y"], KEYS)


AUDIT_TERMS = [
    ("missing_tokens", "tokens", "nom_segment_raw", f"from trimmed where nom_segment_raw in {TOKEN_LIST}"),
    ("label_aliases", "low_balance", "low_bal", "from tokened where low_bal = 'Yes, planned'"),
    ("label_aliases", "segments", "nom_segment_raw", "from tokened where nom_segment_raw in ('BUILDING','FURNITURE')"),
    ("row_filter", "priority", "ord_priority", "from labelled where ord_priority = '4-NOT SPECIFIED'"),
    ("structural_na", "low_balance_segment", "nom_segment_raw", "from filtered where nom_segment_raw is null and low_bal = 'No'"),
    ("structural_na", "no_lines", "cnt_lines", "from s1 where cnt_lines is null and (nom_segment_raw = 'NotApplicable' or low_bal = 'Yes')"),
    ("structural_na", "gate_all", "low_bal", "from s2 where low_bal is null and ortime = '0' and nom_segment_raw = 'PROPERTY'"),
    *[("ladder", "qty", f"qty{i}", f"from rungs where qty{i} is null and {n} > last_rung") for n, i in enumerate(INDICES, 1)],
    ("implausible", "sentinel", "cont_price", "from laddered where cont_price = 5000.0"),
    ("implausible", "out_of_range", "cont_price", "from sentinel where cont_price < 0 or cont_price > 400000"),
]


@query("c15_rewrite_audit", WITH_TOKENS + "\nselect * from (" + " union all ".join(
    f"select '{s}' step, '{r}' rule, '{c}' feature, count(*) n {q}" for s, r, c, q in AUDIT_TERMS) + ") where n > 0")
def rewrite_audit(spark, sf):
    return h.harmonise_audit(raw(spark, sf), SPEC)


@query("c16_harmonise_chain", WITH_TOKENS + f"\nselect {', '.join(CHAIN_COLUMNS)}, any_low from harmonised")
def harmonise_chain(spark, sf):
    return h.harmonise(raw(spark, sf), SPEC).select(*CHAIN_COLUMNS, "any_low")
