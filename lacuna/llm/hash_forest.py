"""Approximate nearest neighbours with a hash-prefix forest, by inner product.

Every vector gets a long bit string for each tree: the sides of random hyperplanes. A tree
is the array of its vectors sorted by that string, cut into cells: prefixes just long
enough to hold about ``CELL`` vectors, found from a bounded sample. A query first goes
down to the cell of its own string in every tree, the longest prefix it shares with
enough vectors. The score of its k-th best there bounds the angle of the neighbours still
to find, and so the chance that such a neighbour shares a prefix of some length with the
query in one of the trees. The query then goes up in all trees at once, to the longest
prefix at which that chance reaches ``TARGET``, and visits the cells below it. Data
without structure need short prefixes, clustered data long ones: the same rule gives
the recall at every size.

Largest inner product becomes smallest angle by one more component: the root of the
largest squared norm less a vector's own; queries have 0 there. Cells are split into
chunks and query blocks of bounded size, so a prefix that a third of all vectors share
is many tasks. Of equal vectors only the ``k + 1`` with the smallest ids can be
neighbours; the others are queries but no candidates. Every vector is indexed.

Vectors take no part that are null, zero, or hold nulls or non-finite components, or
whose length is not the commonest one (of equally common ones the largest); nor do null
ids. Of several vectors with the same id the smallest takes part. Ties go to the smaller
id. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.storage import written

TREES, BITS = 16, 30
#: Vectors of a cell and of a chunk of it, and queries of a block, as aimed at.
CELL, CHUNK, QUERY_BLOCK = 4096, 8192, 4096
#: Vectors that the cells are fitted on, at most in expectation, and the fewest of them in a cell.
SAMPLE, SAMPLE_A_CELL = 20_000, 16
TARGET = 0.9
SEED = 20
PARTS = "query_id long, vec_id long, score double"


def taking_part(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` (array of double), one row for each id."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fine) & F.exists("x", lambda v: v != 0))
    common = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    kept = kept.filter(F.size("x") == (common[0]["n"] if common else 0))
    return kept.groupBy("vec_id").agg(F.min("x").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Forest:
    """Hyperplanes, and the cells of every tree: their first codes and prefix lengths."""

    def __init__(self, dim: int, norm: float, trees: int):
        self.dim, self.norm, self.trees = dim, norm, trees
        self.planes = np.random.default_rng(SEED).standard_normal((dim + 1, trees * BITS))
        self.starts: list[np.ndarray] = []
        self.depths: list[np.ndarray] = []
        self.chunks: list[np.ndarray] = []
        self.offset = np.zeros(trees + 1, dtype=np.int64)

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings as integers, rows by trees."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        bits = (np.column_stack([x, rest]) @ self.planes > 0).reshape(len(x), self.trees, BITS)
        return (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)

    def cut(self, sample: np.ndarray, n: int) -> None:
        """Cells from the codes of a sample of ``n`` vectors."""
        share = max(1, n) / max(1, len(sample))
        most = max(CELL / share, SAMPLE_A_CELL)
        for t in range(self.trees):
            codes, leaves, open_ = np.sort(sample[:, t]), [], [(0, 0)]
            while open_:
                start, depth = open_.pop()
                step = 1 << (BITS - depth)
                held = np.searchsorted(codes, start + step) - np.searchsorted(codes, start)
                if held > most and depth < BITS:
                    open_ += [(start + step // 2, depth + 1), (start, depth + 1)]
                else:
                    leaves.append((start, depth, max(1, math.ceil(held * share / CHUNK))))
            leaves.sort()
            for kept, values in zip((self.starts, self.depths, self.chunks), zip(*leaves)):
                kept.append(np.array(values, dtype=np.int64))
            self.offset[t + 1] = self.offset[t] + len(leaves)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """The cell of each code, numbered over all trees."""
        return np.column_stack([self.offset[t] + np.searchsorted(self.starts[t], codes[:, t], side="right") - 1 for t in range(self.trees)])

    def level(self, bound: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Longest prefix at which a vector of inner product ``bound`` with a query of norm ``size`` is met with ``TARGET``."""
        cosine = np.clip(bound / np.maximum(self.norm * size, 1e-300), -1.0, 1.0)
        same = np.clip(1.0 - np.arccos(cosine) / np.pi, 1e-12, 1.0 - 1e-12)
        wanted = 1.0 - (1.0 - TARGET) ** (1.0 / self.trees)
        return np.clip(np.floor(np.log(wanted) / np.log(same)), 0, BITS).astype(np.int64)


def index(points: DataFrame, forest: Forest) -> DataFrame:
    """``cell, chunk, vec_id, x``: every vector in its cell of every tree."""
    broad = points.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        forest = broad.value
        chunks = np.concatenate(forest.chunks)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                cells = forest.cells(forest.codes(_matrix(some.column("x")), False))
                ids = some.column("vec_id").to_numpy()
                spread = (ids * np.int64(0x9E3779B1) >> 7) & 0x7FFFFFFF
                for t in range(forest.trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, t]), pa.array(spread % chunks[cells[:, t]]), some.column("vec_id"), some.column("x")], ["cell", "chunk", "vec_id", "x"])

    return points.mapInArrow(run, "cell long, chunk long, vec_id long, x array<double>")


def requests(queries: DataFrame, forest: Forest, up: bool) -> DataFrame:
    """``cell, chunk, query_id, q, bound``: the chunks that queries ``query_id, q, bound`` visit.

    Going down, the cell of a query's own code in every tree; going ``up``, the other
    cells under the prefix that its bound asks for.
    """
    broad = queries.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        forest = broad.value
        chunks = np.concatenate(forest.chunks)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                q = _matrix(some.column("q"))
                codes = forest.codes(q, True)
                own = forest.cells(codes)
                rows, cells = np.repeat(np.arange(len(q)), forest.trees), own.ravel()
                if up:
                    level = forest.level(some.column("bound").to_numpy(zero_copy_only=False), np.sqrt((q * q).sum(axis=1)))
                    rows, cells = [], []
                    for t in range(forest.trees):
                        low = codes[:, t] >> (BITS - level) << (BITS - level)
                        a = np.searchsorted(forest.starts[t], low, side="right") - 1
                        b = np.searchsorted(forest.starts[t], low + (1 << (BITS - level)), side="left")
                        n = np.maximum(b - a, 0)
                        found = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n) + forest.offset[t]
                        of = np.repeat(np.arange(len(q)), n)
                        other = found != own[of, t]
                        rows.append(of[other])
                        cells.append(found[other])
                    rows, cells = np.concatenate(rows), np.concatenate(cells)
                n = chunks[cells]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows, cells = np.repeat(rows, n), np.repeat(cells, n)
                for k in range(0, len(rows), 8192):
                    pick = pa.array(rows[k:k + 8192])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[k:k + 8192]), pa.array(at[k:k + 8192])] + [some.column(c).take(pick) for c in ("query_id", "q", "bound")],
                        ["cell", "chunk", "query_id", "q", "bound"])

    return queries.select("query_id", "q", "bound").mapInArrow(run, "cell long, chunk long, query_id long, q array<double>, bound double")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component: the same for equal vectors wherever they are."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def visit(asked: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of every visited chunk that reach the query's bound."""
    place = ["cell", "chunk"]
    blocks = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = asked.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    indexed = indexed.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x, vec_id = _matrix(right["x"]), right["vec_id"].to_numpy()
            for first in range(0, left.num_rows, 256):
                some = left.slice(first, 256)
                q, query_id = _matrix(some["q"]), some["query_id"].to_numpy()
                bound = some["bound"].to_numpy()
                score = q @ x.T
                score[query_id[:, None] == vec_id[None, :]] = -np.inf
                near = 1e-12 * (1.0 + np.abs(score).max(initial=0, where=np.isfinite(score)))
                cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(q), -np.inf)
                cut = np.maximum(cut, np.where(np.isnan(bound), -np.inf, bound)) - near
                row, col = np.nonzero((score >= cut[:, None]) & np.isfinite(score))
                exact = products(q[row], x[col])
                order = np.lexsort((vec_id[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                for name, values in (("query_id", query_id[row[keep]]), ("vec_id", vec_id[col[keep]]), ("score", exact[keep])):
                    out[name].append(values)
        return pa.table({
            name: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64() if name == "score" else pa.int64()) for name, parts in out.items()})

    keys = [*place, "block"]
    return asked.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInArrow(best, PARTS)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """Rank the distinct pairs of each query; a query has at most ``k`` rows from each chunk that it visited."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, query_filter: str, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest others of the vectors that ``query_filter`` selects."""
    points = written(taking_part(vectors), "points")
    facts = points.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim"),
        F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("square")).first()
    queries = points.filter(query_filter).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    n, dim = facts["n"], facts["dim"] or 0
    # All fit one cell: one tree is enough, and the search is exact.
    forest = Forest(dim, math.sqrt(facts["square"] or 1.0), TREES if n > CELL else 1)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    broad = points.sparkSession.sparkContext.broadcast(forest)

    def coded(batches):
        for batch in batches:
            codes = broad.value.codes(_matrix(batch.column("x")), False) if batch.num_rows else np.zeros((0, broad.value.trees), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.list_(pa.int64()))], ["codes"])

    sample = points.filter(draw < min(1.0, SAMPLE / max(1, n))).mapInArrow(coded, "codes array<long>").toArrow()
    forest.cut(_matrix(sample["codes"]) if sample.num_rows else np.zeros((0, forest.trees), np.int64), n)

    alike = Window.partitionBy("x").orderBy("vec_id")
    indexed = index(points.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k + 1).drop("place"), forest)
    down = visit(requests(queries.withColumn("bound", F.lit(None).cast("double")), forest, False), indexed, k)
    down = written(nearest(down, k), "down")
    if forest.trees == 1:
        return down.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    bounds = down.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1e300)))
    up = visit(requests(bounded, forest, True), indexed, k)
    return nearest(down.select("query_id", "vec_id", "score").union(up), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The exact search, which the forest equals while one cell holds all vectors.
SQL = """
with v as (
  select vec_id, min(embedding::double[]) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
    and len(list_filter(embedding, lambda y: y <> 0)) > 0 group by vec_id),
q as (
  select a.vec_id as query_id, b.vec_id, list_reduce(list_prepend(0.0::double, list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), lambda s, y: s + y) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from q) where rank <= 20
"""
