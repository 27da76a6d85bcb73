"""What is declared before a run: variables, kinds, levels, units of the grid."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lacuna.functions.frames import local_frame

KINDS = ("binary", "ordinal", "nominal", "continuous", "count")
CATEGORICAL = ("binary", "ordinal", "nominal")
NUMERIC = ("continuous", "count")

OBSERVED, REGISTRY_MISSING, HELD_OUT = 0, 1, 2


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str
    levels: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")

    @property
    def codes(self) -> dict[str, int]:
        return {label: i for i, label in enumerate(self.levels)}


@dataclass(frozen=True)
class Codebook:
    """Kind and ordered labels of every variable; the code of a label is its position."""

    variables: tuple[Variable, ...]

    def __getitem__(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.variables]

    @property
    def kinds(self) -> dict[str, str]:
        return {v.name: v.kind for v in self.variables}

    def of_kind(self, *kinds: str) -> list[str]:
        return [v.name for v in self.variables if v.kind in kinds]

    def subset(self, names) -> Codebook:
        wanted = set(names)
        return Codebook(tuple(v for v in self.variables if v.name in wanted))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``feature, kind, level, code``; numeric variables carry one row without a level."""
        rows = []
        for v in self.variables:
            if v.levels:
                rows += [(v.name, v.kind, label, code) for label, code in v.codes.items()]
            else:
                rows.append((v.name, v.kind, None, None))
        return local_frame(spark, rows, "feature string, kind string, level string, code int")

    @classmethod
    def from_rows(cls, rows) -> Codebook:
        """From collected ``feature, kind, level, code`` rows (bounded by the level limit)."""
        grouped: dict[str, tuple[str, list[tuple[int, str]]]] = {}
        for row in rows:
            kind, levels = grouped.setdefault(row["feature"], (row["kind"], []))
            if row["level"] is not None:
                levels.append((row["code"], row["level"]))
        return cls(tuple(
            Variable(name, kind, tuple(label for _, label in sorted(levels)))
            for name, (kind, levels) in grouped.items()
        ))


@dataclass(frozen=True)
class MaskSettings:
    """Defaults of the masking stage."""

    designs: tuple[str, ...] = ("mcar", "mnar")
    alphas: tuple[float, ...] = (0.05, 0.20)
    seed: int = 2025
    tail_quantile: float = 0.30
    tail_weight: float = 3.0
    degenerate_tail: float = 0.05
    rare_weight: float = 3.0
    min_distinct: int = 12
    driver_min_observed: float = 0.99
    max_drivers: int = 40
    logit_scale: float = 3.0
    logit_clip: float = 10.0


@dataclass(frozen=True)
class Study:
    """A wide encoded matrix's declared side: cohorts, codebook, mask settings.

    ``cohorts`` is declared rather than discovered so that the size of every
    per-column lookup (cohorts x columns x units) is known before the job runs.
    """

    codebook: Codebook
    cohorts: tuple[str, ...]
    masks: MaskSettings = field(default_factory=MaskSettings)
    id_column: str = "recordid"

    @property
    def keys(self) -> list[str]:
        return ["cohort", self.id_column]

    def groups(self, *, designs: bool = False, alphas: bool = False, methods: int = 1) -> int:
        """Upper bound on (cohort, column, unit) groups."""
        n = len(self.cohorts) * len(self.codebook.variables) * methods
        n *= len(self.masks.designs) if designs else 1
        return n * (len(self.masks.alphas) if alphas else 1)

    def with_masks(self, **changes) -> Study:
        return replace(self, masks=replace(self.masks, **changes))
