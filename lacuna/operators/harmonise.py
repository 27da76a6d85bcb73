"""Bring differently exported sources onto one schema.

Every value rule is a :class:`Rewrite`: per column a hit condition and the new
value. The same object drives the projection and the audit count, so both run in
one pass over the source and Catalyst fuses the whole chain into one projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.columns import as_number, clip
from lacuna.functions.frames import bounded, local_frame, require_empty, require_unique

NOT_APPLICABLE = "NotApplicable"


# -- names and keys ---------------------------------------------------------


def normalised_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def normalise_column_names(frame: DataFrame) -> DataFrame:
    """Lower-case snake names; raises when two columns end up with the same name."""
    names = [normalised_name(c) for c in frame.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after normalisation: {clashes}")
    return frame.toDF(*names)


def apply_column_aliases(frame: DataFrame, aliases: Mapping[str, str], cohort: str = "?") -> DataFrame:
    """Rename to canonical names; an absent source or an existing target is an error."""
    absent = sorted(set(aliases) - set(frame.columns))
    if absent:
        raise KeyError(f"[{cohort}] alias source(s) not in the table: {absent}")
    taken = sorted(set(aliases.values()) & set(frame.columns))
    if taken:
        raise ValueError(f"[{cohort}] alias target(s) already in the table: {taken}")
    return frame.withColumnsRenamed(dict(aliases))


def align_on_id(target: DataFrame, source: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """Copy columns by key; both sides must have unique keys."""
    for frame, side in ((target, "target"), (source, "source")):
        if id_column not in frame.columns:
            raise KeyError(f"{side} has no column {id_column!r}")
        require_unique(frame, [id_column], side)
    present = [c for c in columns if c in source.columns]
    return target.drop(*present).join(source.select(id_column, *present), id_column, "left")


def shape_differences(clean: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, plus one row per column that differs in name or type."""
    left, right = dict(clean.dtypes), dict(other.dtypes)
    columns = sorted({c for c in left.keys() | right.keys() if left.get(c) != right.get(c)})
    marks = clean.select(*keys, F.lit(True).alias("_l")).join(
        other.select(*keys, F.lit(True).alias("_r")), list(keys), "full_outer"
    )
    lone = marks.filter("_l is null or _r is null").select(
        F.when(F.col("_r").isNull(), "only_in_clean").otherwise("only_in_other").alias("issue"),
        F.concat_ws("|", *keys).alias("item"),
    )
    if not columns:
        return lone
    schema = local_frame(clean.sparkSession, [("column", c) for c in columns], "issue string, item string")
    return lone.unionByName(schema)


def join_targets(
    predictors: DataFrame, targets: DataFrame, keys: Sequence[str], *, check: bool = True
) -> DataFrame:
    """One-to-one left join; a held-out column among the predictors is an error."""
    held_out = set(targets.columns) - set(keys)
    leaked = sorted(held_out & set(predictors.columns))
    if leaked:
        raise ValueError(f"held-out column(s) present as predictors: {leaked}")
    if check:
        require_unique(predictors, keys, "predictors")
        require_unique(targets, keys, "targets")
    return predictors.join(targets, list(keys), "left")


# -- value rules ------------------------------------------------------------


@dataclass(frozen=True)
class Rewrite:
    """``changes`` maps a column to (hit condition, new value)."""

    step: str
    rule: str
    changes: dict[str, tuple[Column, Column]] = field(default_factory=dict)

    def apply(self, frame: DataFrame) -> DataFrame:
        if not self.changes:
            return frame
        return frame.withColumns(
            {c: F.when(hit, new).otherwise(F.col(c)) for c, (hit, new) in self.changes.items()}
        )


def _text_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]


def trim_text(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.trim(F.col(c)) for c in _text_columns(frame)})


def missing_token_rules(frame: DataFrame, tokens: Sequence[str], skip: Sequence[str] = ()) -> list[Rewrite]:
    """Text equal to a "not recorded" token becomes NULL; numeric columns are left alone."""
    null = F.lit(None).cast("string")
    changes = {
        c: (F.trim(F.col(c)).isin(list(tokens)), null) for c in _text_columns(frame) if c not in skip
    }
    return [Rewrite("missing_tokens", "tokens", changes)]


def label_alias_rules(frame: DataFrame, groups: Sequence[Mapping]) -> list[Rewrite]:
    """Groups of ``{columns, map}``, applied in their order."""
    rules = []
    for number, group in enumerate(groups, 1):
        mapping = dict(group.get("map") or {})
        if not mapping:
            continue
        lookup = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
        changes = {}
        for c in group.get("columns", []):
            if c in frame.columns:
                label = F.trim(F.col(c).cast("string"))
                changes[c] = (label.isin(list(mapping)), F.element_at(lookup, label))
        rules.append(Rewrite("label_aliases", str(group.get("name", f"group{number}")), changes))
    return rules


def row_filter_condition(rule: Mapping) -> Column:
    """True for the rows a ``{column, exclude_values, keep_null}`` rule keeps."""
    excluded = F.col(rule["column"]).isin(list(rule["exclude_values"]))
    return ~F.coalesce(excluded, F.lit(not rule.get("keep_null", True)))


def apply_row_filters(frame: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    for rule in rules:
        if rule["column"] in frame.columns:
            frame = frame.filter(row_filter_condition(rule))
    return frame


def condition_mask(frame: DataFrame, when: Mapping[str, Sequence], mode: str = "any") -> Column:
    """``column in values`` tests joined by OR or AND; an absent column makes it all false."""
    if not when or any(c not in frame.columns for c in when):
        return F.lit(False)
    tests = [
        F.coalesce(F.col(c).cast("string").isin([str(v) for v in values]), F.lit(False))
        for c, values in when.items()
    ]
    return reduce(and_ if mode == "all" else or_, tests)


def structural_rules(frame: DataFrame, rules: Sequence[Mapping]) -> list[Rewrite]:
    """Fill blanks whose question did not apply; only NULL cells are written."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    out = []
    for rule in rules:
        mask = condition_mask(frame, rule.get("when") or {}, rule.get("when_mode", "any"))
        changes = {}
        for c in rule.get("categorical", []):
            if c not in types:
                continue
            if isinstance(types[c], T.NumericType):
                raise TypeError(f"rule {rule.get('name')!r}: {c!r} is numeric, list it under numeric_zero")
            changes[c] = (mask & F.col(c).isNull(), F.lit(str(rule.get("fill", NOT_APPLICABLE))))
        for c in rule.get("numeric_zero", []):
            if c in types:
                changes[c] = (mask & F.col(c).isNull(), F.lit(0).cast(types[c]))
        out.append(Rewrite("structural_na", str(rule.get("name", "?")), changes))
    return out


def ladder_rules(
    frame: DataFrame, families: Sequence[str], indices: Sequence[str], fill: str = NOT_APPLICABLE
) -> list[Rewrite]:
    """Fill a repeated-measure family past the row's last recorded rung."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    out = []
    for stem in families:
        rungs = [f"{stem}{i}" for i in indices if f"{stem}{i}" in types]
        if len(rungs) < 2:
            continue
        last = F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(i)).otherwise(F.lit(0)) for i, c in enumerate(rungs, 1)])
        changes = {c: (F.col(c).isNull() & (F.lit(i) > last), F.lit(fill).cast(types[c])) for i, c in enumerate(rungs, 1)}
        out.append(Rewrite("ladder", stem, changes))
    return out


def implausible_rules(
    frame: DataFrame,
    bounds: Mapping[str, Mapping[str, float]],
    sentinels: Mapping[str, Sequence[float]],
) -> list[Rewrite]:
    """Sentinel codes, then values outside [min, max], become NULL; nothing is clipped."""
    types = {f.name: f.dataType for f in frame.schema.fields}

    def blank(c: str) -> Column:
        return F.lit(None).cast(types[c])

    exact = {
        c: (as_number(F.col(c)).isin([float(v) for v in values]), blank(c))
        for c, values in sentinels.items() if c in types
    }
    ranges = {}
    for c, spec in bounds.items():
        if c in types:
            number = as_number(F.col(c))
            ranges[c] = ((number < float(spec["min"])) | (number > float(spec["max"])), blank(c))
    return [Rewrite("implausible", "sentinel", exact), Rewrite("implausible", "out_of_range", ranges)]


# -- derived endpoints and numeric coercion ---------------------------------


def any_of(parts: Sequence[str], positive="Yes", negative="No") -> Column:
    """Positive if any part is, NULL only if every part is, otherwise negative."""
    hit = reduce(or_, [F.coalesce(F.col(c) == F.lit(positive), F.lit(False)) for c in parts])
    empty = reduce(and_, [F.col(c).isNull() for c in parts])
    return F.when(hit, F.lit(positive)).when(~empty, F.lit(negative))


def zero_where_flag_is_zero(endpoint: str, flag: str) -> Column:
    """Endpoint with NULL replaced by 0 where the event flag says it never happened."""
    value = as_number(F.col(endpoint))
    return F.when(value.isNull() & (as_number(F.col(flag)) == 0), F.lit(0.0)).otherwise(value)


def as_binary(frame: DataFrame, columns: Sequence[str], unit: Sequence[str] = (), max_units: int | None = None) -> DataFrame:
    """{1, 2} coded columns become {0, 1}; anything else is rounded (half to even) and clipped.

    With ``unit`` the coding is told for each unit, so stacked units may be coded differently.
    """
    rounded = {c: F.rint(as_number(F.col(c))) for c in columns}
    profile = frame.groupBy(*unit).agg(*[
        ((F.min(rounded[c]) >= 1) & (F.max(rounded[c]) == 2)).alias(f"_shift_{c}") for c in columns
    ])
    if unit:
        out = frame.join(bounded(profile, max_units), list(unit))
    else:
        out = frame.crossJoin(F.broadcast(profile))  # the profile is one row
    out = out.withColumns({
        c: F.when(F.col(f"_shift_{c}"), rounded[c] - 1).otherwise(clip(rounded[c], 0, 1)) for c in columns
    })
    return out.drop(*[f"_shift_{c}" for c in columns])


def target_series(frame: DataFrame, keys: Sequence[str], target: str, binary: bool, zero_flag: str | None = None) -> DataFrame:
    """Typed endpoint column with its keys."""
    if binary:
        return as_binary(frame, [target]).select(*keys, target)
    value = zero_where_flag_is_zero(target, zero_flag) if zero_flag else as_number(F.col(target))
    return frame.select(*keys, value.alias(target))


def coerce_features(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys trimmed, every other column numeric or NULL."""
    return frame.select(
        *[F.trim(F.col(k).cast("string")).alias(k) for k in keys],
        *[as_number(F.col(c)).alias(c) for c in frame.columns if c not in keys],
    )


def drop_outcomes(frame: DataFrame, outcomes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Drop columns named like an outcome or prefixed ``<outcome>_``."""
    bad = [
        c for c in frame.columns
        if c not in keys and any(c == o or c.startswith(f"{o}_") for o in outcomes)
    ]
    return frame.drop(*bad)


# -- the chain --------------------------------------------------------------


@dataclass(frozen=True)
class HarmoniseSpec:
    """Everything declared for one run. The order of the steps is fixed: names,
    aliases, tokens, labels, row filters, structural fills, ladders, implausible
    values, derived endpoints."""

    aliases: Mapping[str, str] = field(default_factory=dict)
    tokens: Sequence[str] = ()
    label_groups: Sequence[Mapping] = ()
    row_filters: Sequence[Mapping] = ()
    structural: Sequence[Mapping] = ()
    ladder_families: Sequence[str] = ()
    ladder_indices: Sequence[str] = ()
    ladder_fill: str = NOT_APPLICABLE
    bounds: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    sentinels: Mapping[str, Sequence[float]] = field(default_factory=dict)
    any_of: Mapping[str, Sequence[str]] = field(default_factory=dict)
    keys: Sequence[str] = ("recordid",)


def _steps(frame: DataFrame, spec: HarmoniseSpec, cohort: str):
    """The opening frame and the step functions, each giving the next rules."""
    opened = trim_text(apply_column_aliases(normalise_column_names(frame), spec.aliases, cohort))
    before = [
        lambda f: missing_token_rules(f, spec.tokens, spec.keys),
        lambda f: label_alias_rules(f, spec.label_groups),
    ]
    after = [
        lambda f: structural_rules(f, spec.structural),
        lambda f: ladder_rules(f, spec.ladder_families, spec.ladder_indices, spec.ladder_fill),
        lambda f: implausible_rules(f, spec.bounds, spec.sentinels),
    ]
    return opened, before, after


def harmonise(frame: DataFrame, spec: HarmoniseSpec, cohort: str = "?") -> DataFrame:
    """The whole chain: row-local, so one scan and no shuffle."""
    out, before, after = _steps(frame, spec, cohort)
    for step in before:
        for rule in step(out):
            out = rule.apply(out)
    out = apply_row_filters(out, spec.row_filters)
    for step in after:
        for rule in step(out):
            out = rule.apply(out)
    for name, parts in spec.any_of.items():
        present = [p for p in parts if p in out.columns]
        if present:
            out = out.withColumn(name, any_of(present))
    return out


def harmonise_audit(frame: DataFrame, spec: HarmoniseSpec, cohort: str = "?") -> DataFrame:
    """Cells changed per ``step, rule, column`` and rows dropped, from one scan."""
    out, before, after = _steps(frame, spec, cohort)
    marks: list[tuple[str, str, str, Column]] = []
    flags = 0

    def run(current: DataFrame, rules: list[Rewrite]) -> DataFrame:
        nonlocal flags
        for rule in rules:
            hits = {}
            for c, (hit, _) in rule.changes.items():
                name = f"_hit{flags}"
                flags += 1
                hits[name] = F.coalesce(hit, F.lit(False)) & F.col("_kept")
                marks.append((rule.step, rule.rule, c, F.col(name)))
            current = rule.apply(current.withColumns(hits)) if hits else current
        return current

    out = out.withColumn("_kept", F.lit(True))
    for step in before:
        out = run(out, step(out.drop("_kept")))
    for rule in spec.row_filters:
        if rule["column"] in out.columns:
            name = f"_hit{flags}"
            flags += 1
            out = out.withColumn(name, F.col("_kept") & ~row_filter_condition(rule))
            out = out.withColumn("_kept", F.col("_kept") & row_filter_condition(rule))
            marks.append(("row_filter", str(rule.get("name", "?")), rule["column"], F.col(name)))
    for step in after:
        out = run(out, step(out.drop("_kept")))

    totals = out.agg(*[F.count_if(hit).alias(f"n{i}") for i, (_, _, _, hit) in enumerate(marks)])
    rows = F.array(*[
        F.struct(F.lit(s).alias("step"), F.lit(r).alias("rule"), F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"))
        for i, (s, r, c, _) in enumerate(marks)
    ])
    return totals.select(F.inline(rows)).filter("n > 0")


def require_no_numeric_text(frame: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a column meant to be categorical holds numbers only."""
    tests = frame.select(F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]).alias("feature", "v"))
    numeric = tests.filter("v is not null").groupBy("feature").agg(F.bool_and(as_number(F.col("v")).isNotNull()).alias("numeric"))
    require_empty(numeric.filter("numeric").select("feature"), "categorical column(s) hold numbers")
