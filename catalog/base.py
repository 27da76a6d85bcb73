"""Registry of queries, and the study they share.

The study is a two-cohort registry derived from orders, customers and line
items. Missingness is arithmetic on the key, so both engines see the same gaps.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.frames import checkpoint_dir
from lacuna.operators.profile import encode
from lacuna.plans.schema import Codebook, MaskSettings, Study, Variable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its equivalent SQL, if it has one."""

    def add(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


# -- the registry -----------------------------------------------------------

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

LINES_SQL = """select l_orderkey k, count(*) n_lines,
    max(case when l_linenumber=1 then l_quantity end) qty01, max(case when l_linenumber=2 then l_quantity end) qty02,
    max(case when l_linenumber=3 then l_quantity end) qty03, max(case when l_linenumber=4 then l_quantity end) qty04,
    max(case when l_linenumber=5 then l_quantity end) qty05, max(case when l_linenumber=6 then l_quantity end) qty06,
    max(case when l_linenumber=7 then l_quantity end) qty07,
    round(sum(l_extendedprice*(1-l_discount)),4) revenue
  from {lineitem} group by l_orderkey"""

REGISTRY_SQL = """select case when o_orderkey % 3 = 0 then 'B' else 'A' end as cohort, cast(o_orderkey as varchar(20)) as recordid,
  case when (o_orderkey*7+3)%10<2  then null else o_totalprice end cont_price,
  case when (o_orderkey*11+5)%20<3 then null else c_acctbal end cont_bal,
  case when (o_orderkey*13+1)%10<1 then null else c_mktsegment end nom_segment,
  case when (o_orderkey*17+2)%20<1 then null else o_orderpriority end ord_priority,
  case when (o_orderkey*19+4)%10<3 then null when c_acctbal<2000 then 'Yes' else 'No' end bin_lowbal,
  case when n_lines>9 then 9 else n_lines end cnt_lines, n_regionkey nom_region, year(o_orderdate) cont_year,
  qty01,qty02,qty03,qty04,qty05,qty06,qty07,
  case when o_orderstatus='F' then 1 else 0 end y_bin, revenue y_cont
from {orders} join {customer} on o_custkey=c_custkey join {nation} on c_nationkey=n_nationkey left join {li} on k=o_orderkey"""

_PLAIN = {"lineitem": "lineitem", "orders": "orders", "customer": "customer", "nation": "nation", "li": "li"}

# CTEs for the SQL side.
WITH_REGISTRY = f"""with li as ({LINES_SQL.format(**_PLAIN)}),
registry as ({REGISTRY_SQL.format(**_PLAIN)})"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation")}
    li = spark.sql(LINES_SQL, lineitem=t["lineitem"])
    return spark.sql(REGISTRY_SQL, orders=t["orders"], customer=t["customer"], nation=t["nation"], li=li)


COHORTS = ("A", "B")
KEYS = ["cohort", "recordid"]
CODEBOOK = Codebook((
    Variable("cont_price", "continuous"),
    Variable("cont_bal", "continuous"),
    Variable("nom_segment", "nominal", tuple(SEGMENTS)),
    Variable("ord_priority", "ordinal", tuple(PRIORITIES)),
    Variable("bin_lowbal", "binary", ("No", "Yes")),
    Variable("cnt_lines", "count"),
    Variable("nom_region", "nominal", tuple("01234")),
    Variable("cont_year", "continuous"),
))
STUDY = Study(CODEBOOK, COHORTS, MaskSettings())
MAR_STUDY = STUDY.with_masks(designs=("mar",), driver_min_observed=0.94)


_STORED: dict[tuple, str] = {}


def _bytes(setting: str) -> int:
    """A size of a Spark setting: ``4194304``, ``134217728b``, ``16m``."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def _spread(frame: DataFrame) -> DataFrame:
    """Give every core a part when the input is small: fewer files than cores, and too few bytes for Spark to cut them
    into a few splits for each core, also of a table that holds a part of them. A larger input, in however few files, is left as it is: another shuffle of all rows would only cost."""
    spark, files = frame.sparkSession, frame.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return frame
    if files:  # only the lengths are read here, not the files
        length = spark.read.format("binaryFile").load([unquote(f) for f in files]).agg(F.sum("length")).first()[0] or 0
        if length >= 4 * cores * _bytes(spark.conf.get("spark.sql.files.openCostInBytes")):
            return frame
    return frame.repartition(cores)


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage output, written once per session to the shared folder and read back.

    The stages of a study hand over files: a matrix is joined together once and
    the many small fits that follow read only the columns they need.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{scratch(spark)}/{name}"
        _spread(build()).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "encoded", lambda: encode(registry(spark, sf), CODEBOOK, KEYS))


def _sql_code(v: Variable) -> str:
    if not v.levels:
        return f"cast({v.name} as double) {v.name}"
    whens = " ".join(f"when '{label}' then {code}.0" for label, code in v.codes.items())
    return f"cast(case cast({v.name} as varchar) {whens} end as double) {v.name}"


WITH_ENCODED = WITH_REGISTRY + ",\nencoded as (select cohort, recordid, " + ", ".join(
    _sql_code(v) for v in CODEBOOK.variables
) + " from registry)"


def sql_cells(source: str = "encoded", codebook: Codebook = CODEBOOK) -> str:
    """Long form of an encoded relation: cohort, recordid, feature, kind, value."""
    return " union all ".join(
        f"select cohort, recordid, '{v.name}' feature, '{v.kind}' kind, {v.name} as value from {source}"
        for v in codebook.variables
    )


WITH_CELLS = WITH_ENCODED + f",\ncells as ({sql_cells()})"


def sql_uniform(*parts: str) -> str:
    """SQL twin of the hashed uniform."""
    text = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5({text}),1,12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


ALPHAS_SQL = "(values (cast(0.05 as double)), (cast(0.20 as double))) a(alpha)"
SEED_SQL = "cast(('0x' || substr(sha256('2025|' || cohort || '|' || design),1,8))::BIGINT as varchar)"

# Weighted order per (cohort, design, feature), written as a plain window.
WITH_BUDGET = WITH_CELLS + f""",
profile as (select cohort, feature, count(*) n, count(value) n_observed from cells group by 1,2),
budget0 as (select cohort, feature, alpha, n_observed,
    cast(floor(n * alpha * ((n - n_observed) / cast(n as double))) as bigint) budget
  from profile, {ALPHAS_SQL} where n_observed < n and n_observed > 0),
budget as materialized (select cohort, feature, alpha, budget from (
    select *, max(budget) over (partition by cohort, feature) top from budget0) where top > 0 and n_observed >= top)"""

WITH_WEIGHTS = WITH_BUDGET + """,
levels as materialized (select cohort, feature, kind, value, count(*) n from cells where value is not null group by all),
ends as (select cohort, feature, quantile_cont(value, 0.3) low, quantile_cont(value, 0.7) high
  from cells where kind in ('continuous','count') and value is not null group by 1,2),
tail as (select cohort, feature, avg(case when value <= low or value >= high then 1.0 else 0.0 end) share
  from cells join ends using (cohort, feature) where value is not null group by 1,2),
rules as (select l.cohort, l.feature, low, high, n_levels,
    case when kind in ('binary','ordinal','nominal') or n_levels < 12 then 'rare'
         when share > 0.95 or share < 0.05 then 'rare_wide' else 'tails' end branch
  from (select cohort, feature, kind, count(*) n_levels from levels group by 1,2,3) l
  left join ends using (cohort, feature) left join tail using (cohort, feature)),
ranked as (select cohort, feature, value, row_number() over (partition by cohort, feature order by n, value) r,
    count(*) over (partition by cohort, feature) k from levels),
rare as (select cohort, feature, value from ranked where k >= 2 and r <= greatest(1, k // 2)),
weights as materialized (
  select cohort, recordid, feature, kind, value, 'mcar' design, cast(1.0 as double) weight from cells
  union all
  select c.cohort, c.recordid, c.feature, c.kind, c.value, 'mnar' design,
    cast(case when branch = 'tails' then case when c.value <= low or c.value >= high then 3.0 else 1.0 end
         when r.value is not null then 3.0 else 1.0 end as double) weight
  from cells c left join rules u on c.cohort = u.cohort and c.feature = u.feature
  left join rare r on c.cohort = r.cohort and c.feature = r.feature and c.value = r.value)"""

WITH_MASKS = WITH_WEIGHTS + f""",
clocks as materialized (select *, -ln({sql_uniform(SEED_SQL, 'feature', 'recordid')}) / weight clock from weights
  where value is not null and exists (select 1 from budget b where b.cohort = weights.cohort and b.feature = weights.feature)),
drawn as materialized (select cohort, recordid, feature, design,
    row_number() over (partition by cohort, design, feature order by clock, recordid) rn from clocks),
masks as (select w.cohort, w.recordid, w.feature, w.kind, w.design, a.alpha, w.value truth,
    case when w.value is null then 1 when d.rn <= b.budget then 2 else 0 end status,
    case when w.value is null or d.rn <= b.budget then null else w.value end masked
  from weights w cross join {ALPHAS_SQL}
  left join drawn d on d.cohort = w.cohort and d.recordid = w.recordid and d.feature = w.feature and d.design = w.design
  left join budget b on b.cohort = w.cohort and b.feature = w.feature and b.alpha = a.alpha)"""
