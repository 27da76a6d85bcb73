"""A commit log beside the tables of a study: what is not in the log does not count.

A stage writes its table first and its commit last. A commit holds, for each unit, the
table's columns, rows, null cells and a sum of row hashes, and the seeds that took part.
A run that stops between the two leaves a table without a commit, which is written anew;
a table that is no longer what was committed is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lacuna.sources.files import fingerprint, write_units

SCHEMA = "stage string, unit string, columns string, n_rows long, n_null long, hash_sum string, seeds array<int>, at timestamp"


def unit_name(keys: Sequence[str]) -> Column:
    """A unit's keys as one text, whatever their types: a partition column may come back as another one."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.concat_ws("|", *[F.coalesce(p.try_cast("double").cast("string"), p) for p in parts])


def columns_of(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(frame.schema.fields, key=lambda f: f.name))


class CommitLog:
    """The log of the tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/_commits"

    def commits(self, stage: str) -> DataFrame:
        """The newest commit of each unit of a stage."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("stage") == stage)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)
        fields = [c for c in rows.columns if c != "unit"]
        return rows.groupBy("unit").agg(F.max_by(F.struct(*fields), "at").alias("x")).select("unit", "x.*").select(*rows.columns)

    def _evidence(self, table: DataFrame, keys: Sequence[str]) -> DataFrame:
        named = table.withColumn("_unit", unit_name(keys)).drop(*keys)
        return fingerprint(named, ["_unit"]).withColumnRenamed("_unit", "unit").withColumn("hash_sum", F.col("hash_sum").cast("string"))

    def commit(self, stage: str, table: DataFrame, keys: Sequence[str], seeds: Sequence[int] = ()) -> None:
        """Record the units of a table that has been written."""
        rows = self._evidence(table, keys).select(
            F.lit(stage).alias("stage"), "unit", F.lit(columns_of(table)).alias("columns"), "n_rows", "n_null", "hash_sum",
            F.array(*[F.lit(int(s)) for s in seeds]).cast("array<int>").alias("seeds"), F.current_timestamp().alias("at"))
        rows.coalesce(1).write.mode("append").parquet(self.path)  # a row a unit

    def pending(self, stage: str, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Units of ``grid`` without a commit."""
        named = grid.withColumn("unit", unit_name(keys))
        return named.join(self.commits(stage).select("unit"), "unit", "left_anti").drop("unit")

    def violations(self, stage: str, table: DataFrame, keys: Sequence[str], seeds: Sequence[int] = ()) -> DataFrame:
        """``unit, problem`` of committed units: gone, other columns, other rows, other content, a seed missing."""
        found = self._evidence(table, keys).select("unit", F.col("n_rows").alias("rows_now"), F.col("hash_sum").alias("hash_now"))
        wanted = F.array(*[F.lit(int(s)) for s in seeds]).cast("array<int>")
        problem = (
            F.when(F.col("columns") != columns_of(table), "other columns")
            .when(F.col("rows_now").isNull(), "gone").when(F.col("rows_now") != F.col("n_rows"), "other number of rows")
            .when(F.col("hash_now") != F.col("hash_sum"), "other content")
            .when(F.size(F.array_except(wanted, "seeds")) > 0, "a seed is missing"))
        return self.commits(stage).join(found, "unit", "left").select("unit", problem.alias("problem")).filter("problem is not null")

    def require(self, stage: str, table: DataFrame, keys: Sequence[str], seeds: Sequence[int] = ()) -> DataFrame:
        """``table``, if every committed unit is what was committed."""
        wrong = self.violations(stage, table, keys, seeds).limit(5).collect()
        if wrong:
            raise ValueError(f"{stage}: {[r.asDict() for r in wrong]}")
        return table

    def table(self, stage: str, path: str, build: Callable[[], DataFrame], keys: Sequence[str], seeds: Sequence[int] = ()) -> DataFrame:
        """A stage's table: read if it was committed, else written whole and committed."""
        if self.commits(stage).isEmpty():
            build().write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*keys).parquet(path)
            self.commit(stage, self.spark.read.parquet(path), keys, seeds)
            return self.spark.read.parquet(path)
        return self.require(stage, self.spark.read.parquet(path), keys, seeds)

    def add(self, stage: str, path: str, units: DataFrame, keys: Sequence[str], only: Column) -> None:
        """Write some units of a table, in place of what these had, and commit those that ``only`` selects."""
        write_units(units, path, keys)
        self.commit(stage, self.spark.read.parquet(path).filter(only), keys)
