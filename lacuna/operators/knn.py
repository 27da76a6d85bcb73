"""Exact nearest-neighbour imputation without comparing every pair.

Distance is the nan-Euclidean one: ``sqrt(p/|J| * sum_J (x_j - y_j)^2)`` over the
features J both rows have. Since ``p/|J| >= 1``, the distance within the
always-observed features bounds it from below. Rows are put into cells of those
features, cut by a k-d tree over a bounded sample; every row has a cell, and a cell's
box is that of its rows, so the sample decides on speed alone. A receiver first meets
its own block (a cell, or a part of a popular one), which bounds its k-th distance, and
then only the blocks of cells whose box can still hold something nearer. Each task compares one bounded block of
donors with one bounded block of receivers and returns at most k donors per missing cell, so hot blocks (equal
rows, popular neighbourhoods) split by size and no pair is ever emitted.

Inside a task donors lie in leaves of one pattern of gaps, cut along what the pattern has. A leaf's box bounds
the distance over all features that both sides have, so receivers of a pattern meet the nearest leaves first and
leave out those that can hold nothing nearer. What remains is compared by one matrix product, which only has to say
which pairs can be near enough; their distances are then summed as defined. Equal receivers are searched once, and of equal donors the
first k by id are enough.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.functions.columns import hash_number
from lacuna.functions.frames import bounded, cut_lineage, handed_over, pinned

BLOCK_VALUES = 1 << 19  # rows x features of a block
CELL_ROWS = 1000  # a cell's least number of rows; of many rows a core gets two cells, up to a block each
SAMPLE_ROWS = 100_000
LEAF_ROWS = 64
CHUNK_ROWS = 128  # receivers that meet the same leaves
BATCH_ROWS = 4096  # donors that are compared with them at a time
EXACT_VALUES = 4_000_000  # of pairs whose distances are summed at a time
NEIGHBOURS = 3
ROUNDED = 1e-9  # distances are compared with nine digits


def complete_features(frame: DataFrame, unit: Sequence[str], features: Sequence[str]) -> list[str]:
    """Features without a gap in any unit: they may carry the projection."""
    gaps = frame.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in features]).first()
    return [c for c in features if gaps[c] == 0]


def _cell_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """k-d tree over sampled points: ``feature, cut, left`` by node; the children are ``left`` and the next node, a leaf has -1."""
    feature, cut, left, waiting = [-1], [0.0], [0], [(0, points)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= leaf or not own.shape[1]:
            continue
        spread = own.max(axis=0) - own.min(axis=0)
        f = int(spread.argmax())
        if not spread[f] > 0:
            continue
        values, counts = np.unique(own[:, f], return_counts=True)
        at = int(np.abs(np.cumsum(counts)[:-1] - len(own) / 2).argmin())
        feature[node], cut[node], left[node] = f, float(values[at]), len(left)
        below = own[:, f] <= values[at]
        waiting += [(len(left), own[below]), (len(left) + 1, own[~below])]
        feature, cut, left = feature + [-1, -1], cut + [0.0, 0.0], left + [0, 0]
    return np.array(feature), np.array(cut), np.array(left)


def _in_cells(rows: DataFrame, unit: Sequence[str], id_column: str, complete: Sequence[str], cell_rows: int, max_units: int) -> DataFrame:
    """Add ``bucket``: the row's cell in its unit."""
    if not complete:
        return rows.withColumn("bucket", F.lit(0))
    sizes = pinned(rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n")), max_units)
    known = {tuple(r[u] for u in unit): r["_n"] for r in sizes.collect()}
    step = F.greatest(F.ceil(F.col("_n") * len(known) / SAMPLE_ROWS), F.lit(1))
    taken = rows.join(bounded(sizes, max_units), list(unit)).filter(hash_number(F.col(id_column), "cells") % step == 0)
    sampled: dict[tuple, list] = {}
    for r in taken.select(*unit, *complete).limit(2 * SAMPLE_ROWS).collect():
        sampled.setdefault(tuple(r[u] for u in unit), []).append([r[c] for c in complete])
    trees = {k: _cell_tree(np.array(v, dtype=float), max(4, len(v) * cell_rows // known[k])) for k, v in sampled.items()}

    def cell_of(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
        feature, cut, left = tree
        node, own = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            right = x[own, np.maximum(feature[node], 0)] > cut[node]
            node = np.where(inner, left[node] + right, node)

    @F.pandas_udf("int")
    def cell(which: pd.DataFrame, at: pd.DataFrame) -> pd.Series:
        out, x = pd.Series(0, index=which.index), at.to_numpy(dtype=float)
        for key, part in out.groupby([which[c] for c in which.columns], sort=False):
            key = key if isinstance(key, tuple) else (key,)
            if key in trees:
                out.loc[part.index] = cell_of(trees[key], x[part.index])
        return out

    return rows.withColumn("bucket", cell(F.struct(*unit), F.struct(*complete)))


def _gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Squared distance of two intervals."""
    gap = F.greatest(F.lit(0.0), other_low - high, low - other_high)
    return gap * gap


def _keys(x: np.ndarray) -> np.ndarray:
    """A number for each different row."""
    if not x.shape[1]:
        return np.zeros(len(x), dtype=np.int64)
    plain = np.ascontiguousarray(np.where(np.isnan(x), np.nan, x + 0.0))  # one zero and one NaN
    return np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_inverse=True)[1].ravel()


def _leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Places of the rows of ``x`` in leaves of at most ``leaf`` rows but for equal ones: by pattern of gaps, if those are few, then by median cuts."""
    gaps = np.isnan(x)
    patterns = _keys(gaps.astype(np.uint8))
    if len(patterns) and (patterns.max() + 1) * leaf > 2 * len(x):
        patterns = np.zeros(len(x), dtype=np.int64)
    order = np.argsort(patterns, kind="stable")
    waiting = [own for own in np.split(order, np.flatnonzero(np.diff(patterns[order])) + 1) if len(own)]
    out = []
    while waiting:
        own = waiting.pop()
        if len(own) > leaf:
            values = x[own]
            spread = values.max(axis=0) - values.min(axis=0)  # NaN where a row has a gap
            spread = np.where(np.isnan(spread), 0.0, spread)
            f = int(spread.argmax())
            if spread[f] > 0:
                value = values[:, f]
                middle = np.partition(value, len(own) // 2)[len(own) // 2]
                below = value < middle
                if not below.any():
                    below = value <= middle
                waiting += [own[below], own[~below]]
                continue
        out.append(own)
    return out


def _boxes(x: np.ndarray, leaves: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``low, high`` of each leaf and feature, unbounded where a row has a gap, and whether any row is observed."""
    low, high, seen = (np.empty((len(leaves), x.shape[1])) for _ in range(3))
    for k, own in enumerate(leaves):
        values = x[own]
        low[k], high[k], seen[k] = values.min(axis=0), values.max(axis=0), ~np.isnan(values).all(axis=0)
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high), seen


class _Nearest:
    """Up to ``k`` nearest donors of each missing cell of some receivers, and how far they reach.

    ``reach`` bounds the distances that count, at first what is known of the receiver.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, reach: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None):
        self.x, self.y, self.k, self.own = x, y, k, own
        self.open, self.known = np.isnan(x), ~np.isnan(y)
        self.reach = np.where(self.open, reach[:, None], -np.inf)
        none = np.zeros(0, dtype=np.int64)
        self.found: dict[int, tuple] = {int(f): (none, np.zeros(0), none) for f in np.flatnonzero(self.open.any(axis=0))}

    def meet(self, r: np.ndarray, d: np.ndarray):
        """Take in pairs of receivers and donors, each pair once."""
        for first in range(0, len(r), step := max(1, EXACT_VALUES // max(1, self.x.shape[1]))):
            self._meet(r[first:first + step], d[first:first + step])

    def _meet(self, r: np.ndarray, d: np.ndarray):
        p, total, shared = self.x.shape[1], np.zeros(len(r)), np.zeros(len(r))
        for j in range(p):
            gap = self.x[r, j] - self.y[d, j]
            both = ~np.isnan(gap)
            gap[~both] = 0.0
            total += gap * gap
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.round(np.sqrt(p / shared * total), 9)
        some = shared > 0
        if self.own is not None:
            some &= self.own[0][r] != self.own[1][d]
        r, d, distance = r[some], d[some], distance[some]
        for f, held in self.found.items():
            take = self.known[d, f] & (distance <= self.reach[r, f])
            if not take.any():
                continue
            rows, gaps, donors = (np.concatenate([a, b[take]]) for a, b in zip(held, (r, distance, d)))
            order = np.lexsort((donors, gaps, rows))
            rows, gaps, donors = rows[order], gaps[order], donors[order]
            start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
            best = place < self.k
            self.found[f] = rows[best], gaps[best], donors[best]
            last = place == self.k - 1
            self.reach[rows[last], f] = gaps[last]

    def farthest(self, features: np.ndarray) -> np.ndarray:
        return self.reach[:, features].max(axis=1, initial=-np.inf)


def _search(x: np.ndarray, y: np.ndarray, k: int, reach: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """``receiver, feature, donor, distance``: up to k nearest rows of ``y`` for each gap of ``x``, ties to the first row.

    ``reach``: the distance up to which donors of a receiver count. ``own``: ids of both sides if some are alike; such pairs do not meet.
    """
    parts: list[tuple] = []
    n, p = y.shape
    chosen = np.flatnonzero(np.isnan(x).any(axis=1) & ~np.isnan(x).all(axis=1))
    if not n or not len(chosen):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, float))
    leaves = _leaves(y, LEAF_ROWS)
    low, high, seen = _boxes(y, leaves)
    order, sizes = np.concatenate(leaves), np.array([len(own_) for own_ in leaves])
    starts = np.cumsum(sizes) - sizes
    known = ~np.isnan(y)
    counts = np.add.reduceat(known[order].astype(np.int64), starts, axis=0)  # usable donors by leaf and feature
    rare = known.sum(axis=0) < k  # of these all donors are met at once
    with np.errstate(invalid="ignore"):
        center = np.nan_to_num(np.nanmean(y, axis=0)) if known.any() else np.zeros(p)
    ys, my = np.where(known, y - center, 0.0), known.astype(float)
    right = np.concatenate([my, ys, my * ys * ys], axis=1)[order]  # rows in the order of leaves
    norm = float((ys * ys).sum(axis=1).max())
    huge = float(np.nanmax(np.abs(y), initial=0.0)) + float(np.nanmax(np.abs(x), initial=0.0))
    for chunk in _leaves(x[chosen], CHUNK_ROWS):
        for first in range(0, len(chunk), 4 * CHUNK_ROWS):  # equal rows of several ids
            rows = chosen[chunk[first:first + 4 * CHUNK_ROWS]]
            own_x = x[rows]
            near = _Nearest(own_x, y, k, reach[rows], None if own is None else (own[0][rows], own[1]))
            gaps = np.flatnonzero(near.open.any(axis=0))
            few = np.flatnonzero(known[:, gaps[rare[gaps]]].any(axis=1))
            often = gaps[~rare[gaps]]
            r = np.arange(len(rows))
            met = np.zeros(n, dtype=bool)

            def all_of(donors: np.ndarray):
                donors = donors[~met[donors]]
                met[donors] = True
                for at in range(0, len(donors), BATCH_ROWS):
                    part = donors[at:at + BATCH_ROWS]
                    near.meet(np.repeat(r, len(part)), np.tile(part, len(r)))

            if len(few):
                all_of(few)
            if not len(often):
                parts += [(rows[a], np.full(len(a), f), c, b) for f, (a, b, c) in near.found.items()]
                continue
            x_low, x_high, x_seen = _boxes(own_x, [r])
            apart = np.maximum(0.0, np.maximum(low - x_high, x_low - high))
            shared = seen @ x_seen[0]
            bound = np.sqrt(p / np.maximum(shared, 1.0) * (apart * apart).sum(axis=1))
            bound[shared == 0] = np.inf
            near_first = np.argsort(bound, kind="stable")
            if np.isinf(near.farthest(often)).any():
                # The nearest leaves that hold k donors of each feature bound the reach.
                upto = np.argmax(np.cumsum(counts[near_first][:, often], axis=0) >= k, axis=0)
                begin = [order[starts[leaf]:starts[leaf] + sizes[leaf]] for f, last in zip(often, upto) for leaf in near_first[:last + 1] if counts[leaf, f]]
                all_of(np.unique(np.concatenate(begin)))
            xs, mx = np.where(near.open, 0.0, own_x - center), (~near.open).astype(float)
            square = mx * xs * xs
            size = norm + float(square.sum(axis=1).max())
            # Rounding of the product, and of what was centred.
            slack = 1e-12 * size + 1e-15 * p * huge * (np.sqrt(size) + 1.0)
            at, width = 0, 8 * LEAF_ROWS
            while at < len(near_first):
                farthest = near.farthest(often)
                limit = farthest.max()
                if not bound[near_first[at]] <= limit + ROUNDED + 1e-7 * limit:
                    break
                upto = at + int(np.searchsorted(np.cumsum(sizes[near_first[at:]]), width, side="left")) + 1
                batch = near_first[at:upto]
                batch = batch[bound[batch] <= limit + ROUNDED + 1e-7 * limit]
                at, width = upto, BATCH_ROWS
                places = np.concatenate([np.arange(starts[leaf], starts[leaf] + sizes[leaf]) for leaf in batch])
                # total <= reach^2 * shared / p, both sums over what both have, as one product
                most = np.where(farthest >= 0, np.minimum((farthest + ROUNDED) ** 2 / p, 8.0 * size + 1.0), -1.0 - slack)
                left = np.concatenate([square - mx * most[:, None], -2.0 * xs, mx], axis=1)
                hit_r, hit_d = np.nonzero(left @ right[places].T <= slack + 1e-12 * p * np.maximum(most, 0.0)[:, None])
                hit_d = order[places[hit_d]]
                new = ~met[hit_d]
                near.meet(hit_r[new], hit_d[new])
            parts += [(rows[a], np.full(len(a), f), c, b) for f, (a, b, c) in near.found.items()]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _id_codes(receivers: pa.Array, donors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes = pa.chunked_array([receivers, donors]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[:len(receivers)], codes[len(receivers):]


def _nearest_in_block(features: Sequence[str], unit: Sequence[str], id_column: str, k: int, schema: pa.Schema):
    """Cogrouped task: receivers x donors of one block; a row for each receiver with the k nearest donors of each missing cell."""
    p = len(features)

    def values(table: pa.Table) -> np.ndarray:
        flat = table["vec"].combine_chunks().flatten()
        return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p))

    def run(receivers: pa.Table, donors: pa.Table) -> pa.Table:
        if not receivers.num_rows or not donors.num_rows:
            return schema.empty_table()
        donors = donors.take(pc.sort_indices(donors, sort_keys=[(id_column, "ascending")]))  # nulls last
        x, y = values(receivers), values(donors)
        reach = receivers["_reach"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)
        rid, did = _id_codes(receivers[id_column].combine_chunks(), donors[id_column].combine_chunks())
        both = _keys(np.concatenate([x, y]))
        x_key, y_key = both[:len(x)], both[len(x):]
        # A row never gives what it lacks, so only an id with another row, too, has to be kept from itself.
        alike = _pairs_differ(rid, x_key, did, y_key)
        found: list[tuple] = []
        plain, odd = np.flatnonzero(~alike), np.flatnonzero(alike)
        if len(plain):
            order = np.argsort(y_key, kind="stable")
            first = np.r_[True, y_key[order][1:] != y_key[order][:-1]]
            starts = np.flatnonzero(first)
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            kept = np.sort(order[place < k])
            _, one, of = np.unique(x_key[plain], return_index=True, return_inverse=True)
            # Equal receivers may have met others before; the widest reach serves them all.
            widest = np.full(len(one), -np.inf)
            np.maximum.at(widest, of, reach[plain])
            r, f, d, gap = _search(x[plain[one]], y[kept], k, widest)
            by = np.argsort(r, kind="stable")
            sizes = np.bincount(r, minlength=len(one))
            begin = np.cumsum(sizes) - sizes
            times = sizes[of]
            at = by[np.repeat(begin[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            found.append((np.repeat(plain, times), f[at], kept[d[at]], gap[at]))
        if len(odd):
            r, f, d, gap = _search(x[odd], y, k, reach[odd], (rid[odd], did))
            found.append((odd[r], f, d, gap))
        r, f, d, gap = (np.concatenate(v) for v in zip(*found))
        by = np.argsort(r, kind="stable")
        r, f, d, gap = r[by], f[by], d[by], gap[by]
        sizes = np.bincount(r, minlength=len(x))
        some = receivers.select([*unit, id_column])
        cells = pa.StructArray.from_arrays([
            pa.array(f, pa.int32()), pa.array(gap), donors[id_column].combine_chunks().take(pa.array(d)), pa.array(y[d, f]),
        ], fields=list(schema.field("cells").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), cells)
        return pa.Table.from_arrays([*[c.combine_chunks() for c in some.columns], lists], schema=schema)

    return run


def _pairs_differ(rid: np.ndarray, x_key: np.ndarray, did: np.ndarray, y_key: np.ndarray) -> np.ndarray:
    """Receivers with whose id there is a donor with other values."""
    top = int(max(rid.max(), did.max())) + 1
    low, high = np.full(top, np.iinfo(np.int64).max), np.full(top, -1)
    np.minimum.at(low, did, y_key)
    np.maximum.at(high, did, y_key)
    return (high[rid] >= 0) & ((low[rid] != x_key) | (high[rid] != x_key))


def _own_copy(frame: DataFrame) -> DataFrame:
    """Fresh column identities, so that a frame can be grouped with a part of itself."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


def _found(
    frame: DataFrame, unit: Sequence[str], id_column: str, features: Sequence[str], *,
    k: int, block_rows: int | None, max_units: int,
) -> DataFrame:
    """``unit, id, cells``: for each row with gaps ``feature`` (its place), ``distance, donor, donated``, at least the k nearest of each gap, in that order."""
    block_rows = block_rows or max(CELL_ROWS, BLOCK_VALUES // max(1, len(features)))
    complete = complete_features(frame, unit, features)
    doubles = {c: F.col(c).cast("double") for c in features}
    vec = F.array(*[F.when(~F.isnan(x), x) for x in doubles.values()])
    at = [f"_at{j}" for j in range(len(complete))]
    rows = frame.select(*unit, id_column, vec.alias("vec"), *[doubles[c].alias(a) for a, c in zip(at, complete)])
    cores = frame.sparkSession.sparkContext.defaultParallelism
    cell_rows = min(block_rows, max(CELL_ROWS, frame.count() // (2 * cores)))
    placed = _in_cells(rows, unit, id_column, at, cell_rows, max_units)
    placed = handed_over(placed.withColumn("_open", F.exists("vec", lambda v: v.isNull())), "placed")
    boxes = cut_lineage(placed.groupBy(*unit, "bucket").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_splits"),
        *[x for a in at for x in (F.min(a).alias(f"_low{a}"), F.max(a).alias(f"_high{a}"))]))
    sub = (hash_number(F.col(id_column), "block") % F.col("_splits")).cast("int")
    blocked = placed.join(boxes.select(*unit, "bucket", "_splits"), [*unit, "bucket"]).withColumn("sub", sub)
    block = [*unit, "bucket", "sub"]
    types = dict(frame.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in [*unit, id_column])
    schema = f"{head}, cells array<struct<feature: int, distance: double, donor: {types[id_column]}, donated: double>>"
    run = _nearest_in_block(features, unit, id_column, k, to_arrow_schema(T.StructType.fromDDL(schema)))

    receivers = blocked.filter("_open")
    first = receivers.select(*block, id_column, "vec", F.lit(float("inf")).alias("_reach"))
    own = first.groupBy(*block).cogroup(_own_copy(blocked.select(*block, id_column, "vec")).groupBy(*block)).applyInArrow(run, schema)
    own = handed_over(own, "own")

    # The k-th distance found so far bounds where a nearer donor can still be.
    gaps = F.size(F.filter("vec", lambda v: v.isNull()))
    reached = own.select(*unit, id_column, F.size("cells").alias("_n"), F.array_max(F.transform("cells", lambda c: c["distance"])).alias("_far"))
    reached = reached.groupBy(*unit, id_column).agg(F.min("_n").alias("_n"), F.max("_far").alias("_far"))
    searching = receivers.join(reached, [*unit, id_column], "left").withColumn(
        "_reach", F.when(F.col("_n") == k * gaps, F.col("_far")).otherwise(float("inf")))
    searching = searching.withColumnRenamed("bucket", "_ob").withColumnRenamed("sub", "_os").drop("_splits", "_n", "_far")
    searching = handed_over(searching, "searching")
    farthest = searching.groupBy(*unit, "_ob").agg(F.max("_reach").alias("_farthest"))
    own_boxes = boxes.select(*unit, F.col("bucket").alias("_ob"), *[F.col(f"_{e}{a}").alias(f"_own_{e}{a}") for a in at for e in ("low", "high")])
    apart = sum((_gap(F.col(f"_own_low{a}"), F.col(f"_own_high{a}"), F.col(f"_low{a}"), F.col(f"_high{a}")) for a in at), F.lit(0.0))
    pairs = farthest.join(own_boxes, [*unit, "_ob"]).join(boxes, list(unit)).filter(F.sqrt(apart) <= F.col("_farthest") + 1e-6)
    pairs = pairs.filter("bucket <> _ob or _splits > 1").select(*unit, "_ob", "bucket", "_splits", *[f"_{e}{a}" for a in at for e in ("low", "high")])
    away = sum((_gap(F.col(a), F.col(a), F.col(f"_low{a}"), F.col(f"_high{a}")) for a in at), F.lit(0.0))
    visits = searching.join(pairs, [*unit, "_ob"]).filter(F.sqrt(away) <= F.col("_reach") + 1e-6).withColumn(
        "sub", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))
    ).filter("not (bucket = _ob and sub = _os)")
    # A popular block is visited in turns of bounded size; its donors are copied per turn.
    turns = visits.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_turns"))
    turns = cut_lineage(turns)
    turn = (hash_number(F.col(id_column), "turn") % F.col("_turns")).cast("int")
    task = [*block, "turn"]
    visiting = visits.join(turns, block).withColumn("turn", turn).select(*task, id_column, "vec", "_reach")
    hosting = blocked.join(turns, block).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1))
    ).select(*task, id_column, "vec")
    other = visiting.groupBy(*task).cogroup(_own_copy(hosting).groupBy(*task)).applyInArrow(run, schema).filter(F.size("cells") > 0)
    return own.unionByName(other).groupBy(*unit, id_column).agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))


def _best(k: int, feature: Column) -> Column:
    """The k nearest donors of a row's cell."""
    return F.transform(F.slice(F.filter("cells", lambda c: c["feature"] == feature), 1, k), lambda c: F.struct(c["distance"], c["donor"], c["donated"]))


def nearest_donors(
    frame: DataFrame, unit: Sequence[str], id_column: str, features: Sequence[str], *,
    k: int = NEIGHBOURS, block_rows: int | None = None, max_units: int = 1000,
) -> DataFrame:
    """``unit, id, feature, _best``: up to k (distance, donor, value) per missing cell.

    Ties in distance go to the lower donor id.
    """
    found = _found(frame, unit, id_column, features, k=k, block_rows=block_rows, max_units=max_units)
    names = F.array(*[F.lit(c) for c in features])
    cells = found.select(*unit, id_column, "cells", F.explode(F.array_distinct(F.transform("cells", lambda c: c["feature"]))).alias("_f"))
    return cells.select(*unit, id_column, F.get(names, F.col("_f")).alias("feature"), _best(k, F.col("_f")).alias("_best"))


def near_means(
    frame: DataFrame, unit: Sequence[str], id_column: str, features: Sequence[str], *,
    k: int = NEIGHBOURS, weights: str = "uniform", block_rows: int | None = None, max_units: int = 1000,
) -> DataFrame:
    """``unit, id, _near``: for each id with gaps the mean of the nearest donors by feature, in order; null where there is none."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    found = _found(frame, unit, id_column, features, k=k, block_rows=block_rows, max_units=max_units)

    def mean(feature: Column) -> Column:
        best = _best(k, feature)
        zero = F.exists(best, lambda b: b["distance"] == 0)

        def weight(b: Column) -> Column:
            if weights == "uniform":
                return F.lit(1.0)
            return F.when(zero, (b["distance"] == 0).cast("double")).otherwise(1.0 / b["distance"])

        total = F.aggregate(best, F.lit(0.0), lambda a, b: a + b["donated"] * weight(b))
        mass = F.aggregate(best, F.lit(0.0), lambda a, b: a + weight(b))
        return F.when(F.size(best) > 0, total / mass)

    return found.select(*unit, id_column, F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), mean).alias("_near"))


def column_means(frame: DataFrame, unit: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``unit, _means``: of each feature, in order."""
    return frame.groupBy(*unit).agg(F.array(*[F.avg(c) for c in features]).alias("_means"))


def impute_knn(
    frame: DataFrame, unit: Sequence[str], id_column: str, features: Sequence[str], *,
    k: int = NEIGHBOURS, weights: str = "uniform", block_rows: int | None = None, max_units: int = 1000,
) -> DataFrame:
    """``unit, id, feature, imputed`` for every missing cell of the wide numeric frame.

    A cell without any usable donor takes the column mean of its unit. Rounding and
    snapping to valid values is left to ``snap_cells``.
    """
    near = near_means(frame, unit, id_column, features, k=k, weights=weights, block_rows=block_rows, max_units=max_units)
    places = F.array(*[F.when(F.col(c).isNull(), F.lit(j)) for j, c in enumerate(features)])
    gaps = frame.select(*unit, id_column, F.array_compact(places).alias("_gaps")).filter(F.size("_gaps") > 0)
    joined = gaps.join(near, [*unit, id_column], "left").join(bounded(column_means(frame, unit, features), max_units), list(unit), "left")
    cells = joined.select(*unit, id_column, "_near", "_means", F.explode("_gaps").alias("_f"))
    names = F.array(*[F.lit(c) for c in features])
    return cells.select(
        *unit, id_column, F.get(names, F.col("_f")).alias("feature"), F.coalesce(F.get("_near", F.col("_f")), F.get("_means", F.col("_f"))).alias("imputed"))
