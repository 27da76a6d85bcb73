"""Missingness, typing, column selection and the codebook."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.columns import as_number
from lacuna.functions.frames import bounded, local_frame
from lacuna.functions.ordered import grouped_quantiles
from lacuna.operators.harmonise import NOT_APPLICABLE
from lacuna.plans.schema import Codebook

AUTO_NOMINAL_LEVELS = 12
CODEBOOK_ROWS = 1_000_000


def text_cells(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, feature, label``: the text twin of ``to_cells``."""
    args = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return frame.select(*keys, F.stack(F.lit(len(columns)), *args).alias("feature", "label"))


def column_profile(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = ("cohort",)) -> DataFrame:
    """``by, feature, n, n_observed``. One wide aggregate, unpivoted after it has
    shrunk to one row per group."""
    counts = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"_{c}") for c in columns]
    )
    args = [x for c in columns for x in (F.lit(c), F.col(f"_{c}"))]
    return counts.select(*by, "n", F.stack(F.lit(len(columns)), *args).alias("feature", "n_observed")).select(
        *by, "feature", "n", "n_observed"
    )


def missing_share(profile: DataFrame) -> DataFrame:
    share = (F.col("n") - F.col("n_observed")) / F.col("n")
    return profile.withColumn("missing", share)


def missingness_table(frame: DataFrame, columns: Sequence[str], cohorts: Sequence[str]) -> DataFrame:
    """``feature, miss_<cohort>..., miss_max`` over the shared columns."""
    shares = missing_share(column_profile(frame, columns))
    picks = [F.max(F.when(F.col("cohort") == c, F.col("missing"))).alias(f"miss_{c}") for c in cohorts]
    table = shares.groupBy("feature").agg(*picks)
    worst = [F.col(f"miss_{c}") for c in cohorts]
    return table.withColumn("miss_max", F.greatest(*worst) if len(worst) > 1 else worst[0])


def shared_columns(frames: Sequence[DataFrame]) -> list[str]:
    """Strict intersection of the column names."""
    return sorted(set.intersection(*(set(f.columns) for f in frames)))


def selection(
    table: DataFrame,
    *,
    n_predictors: int | None = None,
    max_missing_fraction: float | None = None,
    reserved: Sequence[str] = (),
) -> DataFrame:
    """``feature, miss_max, position, selected, next_excluded`` for one of the two rules.

    The table has one row per column, so ordering it whole is safe.
    """
    if (n_predictors is None) == (max_missing_fraction is None):
        raise ValueError("give exactly one of n_predictors and max_missing_fraction")
    candidates = table.filter(~F.col("feature").isin(list(reserved))) if reserved else table
    order = Window.orderBy("miss_max", "feature")
    ranked = candidates.select("feature", "miss_max", F.row_number().over(order).alias("position"))
    keep = (
        F.col("position") <= n_predictors
        if n_predictors is not None
        else F.col("miss_max") <= float(max_missing_fraction)
    )
    ranked = ranked.withColumn("selected", keep)
    behind = F.col("position") - F.sum(F.col("selected").cast("int")).over(Window.partitionBy())
    return ranked.withColumn("next_excluded", ~F.col("selected") & (behind <= 5))


def column_plan(
    table: DataFrame, *, n_predictors: int | None = None, max_missing_fraction: float | None = None,
    always_keep: Sequence[str] = (), always_drop: Sequence[str] = (), held_out: Sequence[str] = (),
) -> DataFrame:
    """``feature, role, miss_max, position, next_excluded``: what becomes of every column of a missingness table.

    Roles: ``kept`` (also if the table lacks it), ``dropped``, ``held_out``, ``predictor``, ``excluded``. A rule
    that asks for more predictors than there are candidates, or that parts columns with equally many gaps, raises.
    """
    roles = {c: role for role, columns in (("dropped", always_drop), ("held_out", held_out), ("kept", always_keep)) for c in columns}
    judged = selection(table, n_predictors=n_predictors, max_missing_fraction=max_missing_fraction, reserved=list(roles))
    if n_predictors is not None:
        edge = judged.agg(
            F.count(F.lit(1)).alias("candidates"), F.max(F.when(F.col("selected"), F.col("miss_max"))).alias("last_in"),
            F.min(F.when(~F.col("selected"), F.col("miss_max"))).alias("first_out")).first()
        if edge["candidates"] < n_predictors:
            raise ValueError(f"{n_predictors} predictors wanted, {edge['candidates']} shared columns available")
        if edge["last_in"] is not None and edge["last_in"] == edge["first_out"]:
            raise ValueError(f"{n_predictors} predictors would part columns whose largest gap share ties at {edge['last_in']}")
    found = judged.select("feature", F.when(F.col("selected"), "predictor").otherwise("excluded").alias("role"), "miss_max", "position", "next_excluded")
    declared = local_frame(table.sparkSession, list(roles.items()), "feature string, role string")
    return found.unionByName(declared.join(table.select("feature", "miss_max"), "feature", "left"), allowMissingColumns=True)


def plan_summary(plan: DataFrame) -> DataFrame:
    """``role, n, least, most``: columns of each role and the range of their gap shares."""
    return plan.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("miss_max").alias("least"), F.max("miss_max").alias("most"))


def planned_columns(plan: DataFrame) -> list[str]:
    """Kept columns, then predictors, each by name: the schema that a plan leads to."""
    rows = plan.filter(F.col("role").isin("kept", "predictor")).select("role", "feature").orderBy("role", "feature")
    return [r["feature"] for r in rows.collect()]  # as many as columns


# -- data-driven typing -----------------------------------------------------


def value_profile(frame: DataFrame, columns: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """``feature, numeric_storage, n_unique, n, int_like``.

    Values are counted before they are profiled, so a frequent value costs one row.
    """
    numeric = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]
    counted = text_cells(frame, [], columns).filter("label is not null").groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    number = as_number(F.col("label"))
    is_numeric = F.col("feature").isin([c for c in columns if c in numeric] or [""])
    return counted.groupBy("feature").agg(
        F.bool_and(is_numeric).alias("numeric_storage"),
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n").alias("n"),
        F.coalesce(F.bool_and(F.abs(number - F.rint(number)) < eps), F.lit(False)).alias("int_like"),
    )


def classify_columns(
    frame: DataFrame, columns: Sequence[str], *, cat_max: int = 10, cat_frac: float = 0.005, eps: float = 1e-9
) -> DataFrame:
    """``feature, type``: binary, multiclass or continuous; constants are dropped."""
    few = F.col("int_like") & (F.col("n_unique") <= cat_max)
    repeated = F.col("n_unique") / F.col("n") <= cat_frac
    kind = (
        F.when(F.col("n_unique") == 2, "binary")
        .when(~F.col("numeric_storage") | few | repeated, "multiclass")
        .otherwise("continuous")
    )
    return value_profile(frame, columns, eps).filter("n_unique > 1").select("feature", kind.alias("type"))


def feature_meta(masked: DataFrame, columns: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """``feature, type`` by the first rule that matches; constants and all-null columns stay."""
    few = (F.col("int_like") & (F.col("n_unique") <= 10)) | (F.col("n_unique") / F.greatest(F.col("n"), F.lit(1)) <= 0.005)
    kind = (
        F.when(F.col("n_unique") == 2, "binary")
        .when(F.col("numeric_storage") & ~few, "continuous")
        .otherwise("multiclass")
    )
    # A column without values has no profile: no distinct value, hence few of them.
    listed = local_frame(masked.sparkSession, [(c,) for c in columns], "feature string")
    profile = bounded(listed, len(columns)).join(value_profile(masked, columns, eps), "feature", "left")
    return profile.select("feature", F.when(F.col("n_unique").isNull(), "multiclass").otherwise(kind).alias("type"))


def valid_levels(clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, level``: distinct numeric values of the clean table."""
    number = as_number(F.col("label"))
    return (
        text_cells(clean, [], columns).select("feature", number.alias("level")).filter("level is not null").distinct()
    )


# -- codebook ---------------------------------------------------------------


def observed_levels(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, label``: labels seen in any cohort (the frame stacks all cohorts)."""
    return text_cells(frame, [], columns).filter("label is not null").distinct()


@dataclass(frozen=True)
class DeclaredTypes:
    ordinal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    nominal: Sequence[str] = ()
    count: Sequence[str] = ()
    positive: Mapping[str, str] = field(default_factory=dict)
    auto_nominal_levels: int = AUTO_NOMINAL_LEVELS


def _kind_column(declared: DeclaredTypes, numeric: Sequence[str]) -> Column:
    name = F.col("feature")

    def member(names) -> Column:
        return name.isin(list(names)) if names else F.lit(False)

    return (
        F.when(member(declared.count), "count")
        .when(member(numeric) & ~member(list(declared.ordinal)), "continuous")
        .when(member(list(declared.ordinal)), "ordinal")
        .when(F.col("n_levels") == 2, "binary")
        .when(member(declared.nominal) | (F.col("n_levels") <= declared.auto_nominal_levels), "nominal")
    )


def _typed_levels(frame: DataFrame, columns: Sequence[str], declared: DeclaredTypes) -> tuple[DataFrame, list[str]]:
    numeric = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType) and f.name in columns]
    labelled = [c for c in columns if c not in declared.count and (c not in numeric or c in declared.ordinal)]
    levels = observed_levels(frame, labelled) if labelled else local_frame(frame.sparkSession, [], "feature string, label string")
    size = levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"))
    return levels.join(size, "feature").withColumn("kind", _kind_column(declared, numeric)), labelled


def _declared_position(declared: DeclaredTypes) -> Column:
    """Place of a label in its declared order; the off-scale label sits below it."""
    place = F.lit(None).cast("long")
    for name, order in declared.ordinal.items():
        full = F.array(*[F.lit(x) for x in [NOT_APPLICABLE, *order]])
        place = F.when(F.col("feature") == name, F.array_position(full, F.col("label"))).otherwise(place)
    return place


def codebook_problems(frame: DataFrame, columns: Sequence[str], declared: DeclaredTypes) -> DataFrame:
    """``feature, problem``: undeclared ordinal labels, and columns with too many levels."""
    typed, _ = _typed_levels(frame, columns, declared)
    undeclared = typed.filter("kind = 'ordinal'").filter(_declared_position(declared) == 0).select(
        "feature", F.concat(F.lit("undeclared level "), "label").alias("problem")
    )
    wide = typed.filter("kind is null").select(
        "feature", F.concat(F.col("n_levels").cast("string"), F.lit(" levels and no declared type")).alias("problem")
    ).distinct()
    return undeclared.unionByName(wide)


def codebook_frame(frame: DataFrame, columns: Sequence[str], declared: DeclaredTypes) -> DataFrame:
    """``feature, kind, level, code`` for the labelled columns."""
    typed, _ = _typed_levels(frame, columns, declared)
    positive = F.lit("Yes")
    for name, label in declared.positive.items():
        positive = F.when(F.col("feature") == name, F.lit(label)).otherwise(positive)
    place = F.when(F.col("kind") == "ordinal", _declared_position(declared)).when(
        F.col("kind") == "binary", (F.col("label") == positive).cast("long")
    ).otherwise(F.lit(0))
    order = Window.partitionBy("feature").orderBy("_place", "label")
    return (
        typed.filter("kind is not null")
        .withColumn("_place", place)
        .select("feature", "kind", F.col("label").alias("level"), (F.row_number().over(order) - 1).alias("code"))
    )


def build_codebook(frame: DataFrame, columns: Sequence[str], declared: DeclaredTypes) -> Codebook:
    """Decide every kind and label order once for all cohorts; all problems in one error."""
    problems = codebook_problems(frame, columns, declared).orderBy("feature", "problem").limit(CODEBOOK_ROWS + 1).collect()
    if problems:
        if len(problems) > CODEBOOK_ROWS:
            raise ValueError(f"variable types are incomplete: more than {CODEBOOK_ROWS} problems")
        listing = "\n  - ".join(f"{r['feature']}: {r['problem']}" for r in problems)
        raise ValueError(f"variable types are incomplete:\n  - {listing}")
    rows = codebook_frame(frame, columns, declared).limit(CODEBOOK_ROWS + 1).collect()
    if len(rows) > CODEBOOK_ROWS:
        raise ValueError("codebook has too many levels; declare fewer nominal columns")
    stored = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}

    def without_labels(column: str) -> str:
        if column in declared.count:
            return "count"
        if column in declared.ordinal:
            return "ordinal"
        return "continuous" if column in stored else "nominal"  # a text column emptied on the way

    seen = {r["feature"] for r in rows}
    extra = [{"feature": c, "kind": without_labels(c), "level": None, "code": None} for c in columns if c not in seen]
    return Codebook.from_rows([*rows, *extra])


def encode(frame: DataFrame, codebook: Codebook, keys: Sequence[str]) -> DataFrame:
    """Labels to codes, numbers to doubles. An unknown label fails the job, without a second pass."""
    out = []
    for v in codebook.variables:
        if v.name not in frame.columns:
            continue
        if v.kind in ("continuous", "count"):
            out.append(as_number(F.col(v.name)).alias(v.name))
            continue
        label = F.col(v.name).cast("string")
        code = F.lit(None).cast("double")
        for text, number in v.codes.items():
            code = F.when(label == text, F.lit(float(number))).otherwise(code)
        unknown = F.raise_error(F.concat(F.lit(f"{v.name}: label not in the codebook: "), label)).cast("double")
        known = label.isNull() | label.isin(list(v.levels))
        out.append(F.when(known, code).otherwise(unknown).alias(v.name))
    return frame.select(*keys, *out)


def unknown_labels(frame: DataFrame, codebook: Codebook) -> DataFrame:
    """``feature, label, n`` for labels the codebook does not hold."""
    labelled = [v.name for v in codebook.variables if v.levels and v.name in frame.columns]
    seen = text_cells(frame, [], labelled).filter("label is not null").groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = codebook.frame(frame.sparkSession).select("feature", F.col("level").alias("label"))
    return seen.join(known, ["feature", "label"], "left_anti")


def decode(frame: DataFrame, codebook: Codebook, keys: Sequence[str]) -> DataFrame:
    """Codes back to labels; numbers pass through."""
    out = []
    for v in codebook.variables:
        if v.name in frame.columns:
            if v.levels:
                labels = F.array(*[F.lit(x) for x in v.levels])
                out.append(F.get(labels, F.rint(F.col(v.name)).cast("int")).alias(v.name))
            else:
                out.append(F.col(v.name))
    return frame.select(*keys, *out)


# -- taxonomy summaries -----------------------------------------------------


def kind_counts(profile: DataFrame, codebook: Codebook) -> DataFrame:
    """``cohort, kind, n_features`` over the features observed in the cohort."""
    kinds = codebook.frame(profile.sparkSession).select("feature", "kind").distinct()
    return (
        profile.filter("n_observed > 0").join(kinds, "feature")
        .groupBy("cohort", "kind").agg(F.count(F.lit(1)).alias("n_features"))
    )


def field_presence(profile: DataFrame, cohorts: Sequence[str], analysed: Sequence[str]) -> DataFrame:
    """``feature, in_<cohort>..., seen_in, analysed``: where a field is recorded at all."""
    flags = [F.max((F.col("cohort") == c) & (F.col("n_observed") > 0)).alias(f"in_{c}") for c in cohorts]
    table = profile.groupBy("feature").agg(*flags)
    every = F.lit(True)
    for c in cohorts:
        every = every & F.col(f"in_{c}")
    names = F.concat_ws("+", *[F.when(F.col(f"in_{c}"), F.lit(c)) for c in cohorts])
    return table.withColumn("seen_in", F.when(every, "all").otherwise(names)).withColumn(
        "analysed", F.col("feature").isin(list(analysed))
    )


def group_shares(profile: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """``field_group, n_features, share, n_observed``: membership of field groups among predictors."""
    pairs = local_frame(profile.sparkSession, list(groups.items()), "feature string, field_group string")
    per_feature = profile.groupBy("feature").agg(F.sum("n_observed").alias("n_observed"))
    tagged = per_feature.join(pairs, "feature", "left").fillna("other", ["field_group"])
    out = tagged.groupBy("field_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n_observed").alias("n_observed")
    )
    total = F.sum("n_features").over(Window.partitionBy())
    return out.withColumn("share", F.col("n_features") / total)


def median_ratio_check(
    cells: DataFrame, first: str, second: str, *, low: float = 0.5, high: float = 2.0, max_groups: int | None = None
) -> DataFrame:
    """``feature, median_first, median_second, ratio, in_band``: unit mix-ups between two cohorts."""
    medians = grouped_quantiles(cells, ["cohort", "feature"], "value", [0.5], max_groups=max_groups)
    pair = medians.groupBy("feature").agg(
        F.max(F.when(F.col("cohort") == first, F.col("quantile"))).alias("median_first"),
        F.max(F.when(F.col("cohort") == second, F.col("quantile"))).alias("median_second"),
    )
    ratio = F.col("median_first") / F.nullif(F.col("median_second"), F.lit(0.0))
    return pair.withColumn("ratio", ratio).withColumn("in_band", F.col("ratio").between(low, high))
