"""Frame-level helpers: the cell view, checked broadcasts, lineage cuts, key checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A lookup table is broadcast only when its row bound, known before the query
# runs, stays below this; larger ones are left to the optimizer.
BROADCAST_ROWS = 200_000


def bounded(lookup: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast ``lookup`` when ``rows`` bounds its row count below the limit.

    ``rows`` comes from the schema (columns x cohorts x units), never from a
    guess about the data. With no bound the planner and AQE decide.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return F.broadcast(lookup)
    return lookup


def to_cells(
    wide: DataFrame,
    keys: Sequence[str],
    kinds: dict[str, str],
    value: str = "value",
) -> DataFrame:
    """Unpivot into ``keys, feature, kind, value``.

    A generator inside the scan stage: no shuffle, and the long rows exist only
    while they stream into the next aggregate.
    """
    args: list[Column] = [F.lit(len(kinds))]
    for name, kind in kinds.items():
        args += [F.lit(name), F.lit(kind), F.col(name).cast("double")]
    return wide.select(*keys, F.stack(*args).alias("feature", "kind", value))


def to_wide(cells: DataFrame, keys: Sequence[str], features: Sequence[str], value: str = "value") -> DataFrame:
    """Back to one row per key; the pivot list is explicit, so no extra pass."""
    picks = [F.max(F.when(F.col("feature") == name, F.col(value))).alias(name) for name in features]
    return cells.groupBy(*keys).agg(*picks)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster has to name one in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a cached copy."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def handed_over(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to files under the checkpoint folder and read back; later steps read only the columns they need."""
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def require_unique(frame: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise when a key occurs more than once."""
    clash = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
    if clash:
        raise ValueError(f"{what}: key {list(keys)} is not unique, e.g. {[tuple(r)[:-1] for r in clash]}")


def require_empty(frame: DataFrame, message: str) -> None:
    """Raise with up to five offending rows."""
    rows = frame.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pinned(params: DataFrame, rows: int) -> DataFrame:
    """Materialise a parameter table whose size the schema bounds.

    Collects at most ``rows`` rows and raises beyond that, so nothing that grows
    with the data can pass. The result is a local relation: its true size is known
    to the planner (lookups broadcast by the ordinary threshold) and later stages
    do not recompute it.
    """
    collected = params.limit(rows + 1).toArrow()
    if collected.num_rows > rows:
        raise ValueError(f"parameter table exceeds its bound of {rows} rows")
    return params.sparkSession.createDataFrame(collected, params.schema)


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A declared list (seeds, levels, units) as a local relation of known size."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)
