"""Reading and writing exports, matrices, results and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.columns import hash_number

UNIT = ["cohort", "design", "alpha"]

# Result records, as one JSON object per unit and method.
FIDELITY_SCHEMA = (
    "cohort string, design string, alpha double, method string, n_ensemble int, "
    "metrics map<string, map<string, double>>"
)
PREDICTION_SCHEMA_HEAD = (
    "cohort string, design string, alpha double, method string, target string, "
    "is_binary boolean, n_rows long, n_features long"
)


def read_export(spark: SparkSession, path: str, id_column: str = "recordid") -> DataFrame:
    """Raw CSV export: all columns as text, id trimmed. Types are decided later by profiling."""
    frame = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)
    if "or time" in frame.columns:
        frame = frame.withColumnRenamed("or time", "ortime")
    if id_column in frame.columns:
        frame = frame.withColumn(id_column, F.trim(F.col(id_column)))
    return frame


def read_matrix(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def write_units(frame: DataFrame, path: str, partition: Sequence[str] = UNIT) -> None:
    """Parquet partitioned by unit; only the partitions present in ``frame`` are replaced."""
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_report(frame: DataFrame, path: str) -> None:
    """Codebook, selection and count reports as JSON lines."""
    frame.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """Nested result records, with the file each came from."""
    frame = spark.read.schema(schema).json(path)
    return frame.withColumn("source_file", F.col("_metadata.file_name"))


def explode_metrics(records: DataFrame) -> DataFrame:
    """``metrics{metric: {feature: value}}`` to one row per metric and feature."""
    by_metric = records.select(*[c for c in records.columns if c != "metrics"], F.explode("metrics").alias("metric", "_by"))
    return by_metric.select(*[c for c in by_metric.columns if c != "_by"], F.explode("_by").alias("feature", "value"))


def explode_runs(records: DataFrame) -> DataFrame:
    """``runs[]`` to one row per split, numbered from 1."""
    head = [c for c in records.columns if c != "runs"]
    out = records.select(*head, F.posexplode("runs").alias("_pos", "_run"))
    return out.select(*head, (F.col("_pos") + 1).alias("split_repeat"), "_run.*")


def unit_tag(cohort: Column, design: Column, alpha: Column) -> Column:
    """``<cohort>_<DESIGN>_<percent>``."""
    return F.concat_ws("_", cohort, F.upper(design), F.rint(alpha * 100).cast("int").cast("string"))


def parse_stem(path: Column) -> Column:
    """Struct (cohort, design, percent, method) from ``.../<cohort>_<DESIGN>_<percent>_<method>.<ext>``."""
    pattern = r"([^/_]+)_([A-Z]+)_(\d+)_([^/.]+)\.[^/]*$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))

    return F.struct(
        part(1).alias("cohort"), F.lower(part(2)).alias("design"),
        part(3).cast("int").alias("percent"), part(4).alias("method"),
    )


def complete_units(members: DataFrame, seeds: Sequence[int], unit: Sequence[str] = UNIT) -> DataFrame:
    """Units for which every wanted seed has been delivered."""
    wanted = [int(s) for s in seeds]
    return (
        members.filter(F.col("seed").isin(wanted))
        .groupBy(*unit)
        .agg(F.count_distinct("seed").alias("n_seeds"))
        .filter(F.col("n_seeds") == len(wanted))
        .select(*unit)
    )


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid units that are not complete yet."""
    return grid.join(done.select(*keys), list(keys), "left_anti")


def work_list(available: DataFrame, methods: DataFrame, targets: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Every available unit x method x target, minus what is done.

    The factors are declared lists of a few names, so the product is the size of
    the grid and not of the data.
    """
    grid = available.crossJoin(F.broadcast(methods)).crossJoin(F.broadcast(targets))
    return grid if done is None else pending(grid, done, grid.columns)


def fingerprint(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive evidence per key: rows, NULL cells and a sum of row hashes.

    Each cell enters with its length, NULL without one, so different rows have different texts.
    """
    columns = [c for c in frame.columns if c not in keys]
    cells = [F.col(c).cast("string") for c in columns]
    text = [F.when(x.isNull(), "~").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x)) for x in cells]
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(nulls).alias("n_null"),
        F.sum(hash_number(*text).cast("decimal(38,0)")).alias("hash_sum"),
    )
