"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set holds the distinct shingles of five lower-cased words. Its signature
has ``CHUNKS`` x ``CHUNK`` symbols of 11 bits, each from a minimum of its own independent hash, so two documents
differ in about a quarter of the symbols at a similarity of 0.75. By the pigeonhole
principle a pair with fewer than ``CHUNKS * (ERRORS + 1)`` differing symbols has a chunk
with at most ``ERRORS`` of them. The allowed errors of a chunk are enumerated: a key for
each way to leave out ``ERRORS`` of its symbols. Such a pair shares a key, for certain.
(At a similarity of exactly 0.75 about six pairs in a million share none.)

Documents with the same set are one class, joined through its smallest doc_id. Keys of a
single class drop out. Links are confirmed on the full sets, in two steps: first each
class against the smallest class of its keys, twice, which gathers large groups in as
many links as they have members; then all pairs of a key that are still in different
components. In that join the signatures are compared as part of the join condition, so
pairs that are alike by a few common passages only never become rows.

Defined cases: a null or empty text, or one without words, has an empty set and is linked
with nothing. Fewer than five words are one shingle. A null doc_id is returned with a null
component and linked with nothing. Rows that repeat a doc_id are one document: they
share a component, and what is like one of their texts is linked to it. Extra columns
are not read. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.graph import components
from lacuna.llm.storage import written
from lacuna.llm.text import LOWER, WordHasher, blocks, mix, raw, words

WORDS = 5
SIMILARITY = 75  # per cent
CHUNKS, CHUNK, ERRORS = 12, 5, 1
SYMBOLS = CHUNKS * CHUNK
#: Pairs with more differing symbols are not confirmed: at a similarity of 0.75 one pair in a hundred million, far fewer than share no key.
MOST_DIFFERENT = 35
#: A filter by ids is broadcast up to so many of them, and a shuffled join beyond.
BROADCAST_IDS = 1_000_000

#: Keys of more classes are compared in blocks of so many sets and shingles.
LARGE_KEY, BLOCK_SETS, BLOCK_SHINGLES = 64, 512, 1 << 19
SALTS = 64

#: The places of a chunk that its keys keep.
KEPT = list(combinations(range(CHUNK), CHUNK - ERRORS))
#: A chunk is a long: a lane of 12 bits for each symbol, the highest bit of which stays free.
LANE = 12
SIGNATURE = [f"s{k}" for k in range(CHUNKS)]
_SHIFTS = np.arange(CHUNK, dtype=np.uint64) * np.uint64(LANE)
_BELOW = sum(((1 << (LANE - 1)) - 1) << (LANE * p) for p in range(CHUNK))
_FREE = sum(1 << (LANE * p + LANE - 1) for p in range(CHUNK))
#: Makes the hash of each symbol independent of the others.
_SALTS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Shingles hashed at a time for a signature, so that they stay in a processor's cache.
_STRETCH = 1 << 15
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, hasher: WordHasher, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, one text after another; and the ``n + 1`` offsets."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = hasher(data, starts, ends)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    upto = np.cumsum(n)
    place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first[:-1] - (upto - n), n)
    left = np.repeat(first[1:], n) - place  # words from here to the end of the text
    shingles = np.repeat(np.minimum(count, size), n).astype(np.uint64) << np.uint64(56)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        shingles += np.where(left > k, padded[place + k] * _PLACES[k], 0).astype(np.uint64)
    shingles = mix(shingles)
    sets = [np.unique(shingles[b - k:b]) for b, k in zip(upto, n)]
    offsets = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), offsets


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature of each set that is not empty: a 64-bit number for each chunk.

    The k-th hash of a shingle is its own hash with the k-th salt, mixed again.
    """
    filled = offsets[1:] > offsets[:-1]
    full, ends = offsets[:-1][filled], offsets[1:][filled]
    out = np.zeros((len(full), SYMBOLS), dtype=np.uint64)
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(ends, full[first] + _STRETCH, side="right")))
        stretch, at = sets[full[first]:ends[last - 1]], full[first:last] - full[first]
        for k in range(SYMBOLS):
            out[first:last, k] = np.minimum.reduceat(mix(stretch ^ _SALTS[k]), at) & np.uint64((1 << (LANE - 1)) - 1)
        first = last
    return (out.reshape(-1, CHUNKS, CHUNK) << _SHIFTS).sum(axis=2, dtype=np.uint64)


def described(documents: DataFrame) -> DataFrame:
    """``doc_id, n, c0, c1`` and the signature for every row; null but for n = 0 where the set is empty.

    ``c0, c1``: a 128-bit hash of the set.
    """

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches):
            sets, offsets = shingle_sets(block.column("text"), hasher)
            n = np.diff(offsets)
            empty, full = n == 0, offsets[:-1][n > 0]
            columns = [np.add.reduceat(mix(sets ^ np.uint64(salt)), full) if len(full) else np.zeros(0, np.uint64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            columns += list(signatures(sets, offsets).T)
            arrays = []
            for values in columns:
                spread = np.zeros(len(n), dtype=np.int64)
                spread[~empty] = values.view(np.int64) if values.flags.c_contiguous else np.ascontiguousarray(values).view(np.int64)
                arrays.append(pa.array(spread, mask=empty))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n.astype(np.int64)), *arrays], ["doc_id", "n", "c0", "c1", *SIGNATURE])

    columns = ", ".join(f"{c} long" for c in ["doc_id", "n", "c0", "c1", *SIGNATURE])
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, columns)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """``key, at, id``: for every chunk a key for each way to leave out ``ERRORS`` of its symbols; ``at`` numbers them."""
    kept = KEPT

    def run(batches):
        for batch in batches:
            packed = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in SIGNATURE])
            symbols = packed[:, :, None] >> _SHIFTS & np.uint64((1 << LANE) - 1)
            keys = np.empty((len(symbols), CHUNKS, len(kept)), dtype=np.uint64)
            for k, places in enumerate(kept):
                keys[:, :, k] = reduce(lambda key, p: key << np.uint64(LANE) | symbols[:, :, p], places, np.uint64(0))
            keys = mix(keys ^ mix(np.arange(1, 1 + keys[0].size, dtype=np.uint64).reshape(keys.shape[1:]))) if len(keys) else keys
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (CHUNKS * len(kept))), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "keys"])

    return classes.select("id", *SIGNATURE).mapInArrow(run, "id long, keys array<long>").select(F.posexplode("keys").alias("at", "key"), "id")


def differing_in(x: str, y: str, chunk: int) -> Column:
    """How many symbols of a chunk differ in two signatures (structs of longs).

    A lane that differs carries into its free bit when all ones below it are added.
    """
    d = F.col(f"{x}.s{chunk}").bitwiseXOR(F.col(f"{y}.s{chunk}"))
    return F.bit_count((d + F.lit(_BELOW)).bitwiseAND(F.lit(_FREE)))


def differing(x: str, y: str) -> Column:
    """How many symbols of two signatures differ."""
    return reduce(lambda p, q: p + q, [differing_in(x, y, c) for c in range(CHUNKS)])


def first_shared(x: str, y: str, at: str) -> Column:
    """Whether key ``at``, which two signatures share, is the first one that they share.

    The chunk has to be the first within ``ERRORS`` = 1. A chunk with one difference has
    a single shared key, one without differences shares all, of which the first counts.
    """
    out = F
    for c in range(CHUNKS):
        n = differing_in(x, y, c)
        own = (F.expr(f"{at} div {len(KEPT)}") == c) & ((F.col(at) % len(KEPT) == 0) | (n == 1))
        out = out.when(n <= ERRORS, own)
    return out.otherwise(False)


def alike(x: str, y: str) -> Column:
    """What pairs of classes have to meet before their full sets are compared; x and y are structs."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (differing(x, y) <= MOST_DIFFERENT)


def full_sets(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, shingles`` of the documents that ``ids`` (``doc_id``) names, written."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches):
            sets, offsets = shingle_sets(block.column("text"), hasher)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists], ["id", "shingles"])

    sets = documents.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, shingles array<long>")
    return written(sets, "sets")


def confirmed(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of doc_ids whose full sets are similar enough.

    ``a`` may be in the pairs of a whole group: its set goes once to each of ``SALTS`` parts of them.
    """
    sets = full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), documents)
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    firsts = pairs.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(firsts, ["a", "salt"])
    same = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * same >= SIMILARITY * (F.size("x") + F.size("y") - same)).select("a", "b").distinct()


def spanning_links(ids: np.ndarray, component: np.ndarray, block: np.ndarray, values: np.ndarray, offsets: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Links that join the components of sets with a similarity of ``SIMILARITY``, as few as will do.

    All pairs are compared on their full sets, but for those of one component and, if ``across``, of one block.
    Only sets outside the largest component are held against the others, one against all at a time.
    """
    names, place = np.unique(values, return_inverse=True)
    sizes = np.diff(offsets)
    kinds, component = np.unique(component, return_inverse=True)
    parent = list(range(len(kinds)))

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found, own = [], np.zeros(len(names), dtype=np.int32)
    largest = np.bincount(component).argmax()
    for r in np.flatnonzero(component != largest):
        mine = place[offsets[r]:offsets[r + 1]]
        own[mine] = 1
        same = np.add.reduceat(own[place], offsets[:-1])
        own[mine] = 0
        alike = (100 * same >= SIMILARITY * (sizes + sizes[r] - same)) & (component != component[r])
        for t in np.flatnonzero(alike & (block != block[r]) if across else alike):
            a, b = top(component[r]), top(component[t])
            if a != b:
                parent[a] = b
                found.append((int(ids[r]), int(ids[t])))
    return found


def links_of_large_keys(members: DataFrame, documents: DataFrame) -> DataFrame:
    """``a, b``: links between the components of the ``key, id, component`` of keys with many members.

    Members are dealt to blocks of bounded size by a hash; every two blocks of a key meet in a
    task, which compares the full sets there and returns at most a link for each member.
    """
    sets = full_sets(members.select(F.col("id").alias("doc_id")).distinct(), documents)
    sizes = sets.groupBy("id").agg(F.sum(F.size("shingles")).alias("n"))
    dealt = members.join(sizes, "id").groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = written(dealt, "dealt")
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt
    spread = members.join(dealt, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(keys, table):
        lists = table["shingles"].combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        columns = [table[c].combine_chunks().to_numpy() for c in ("id", "component", "block")]
        found = spanning_links(*columns, lists.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0], keys[1] != keys[2])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return spread.join(sets, "id").filter(F.size("shingles") > 0).groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    rows = written(described(documents), "described")
    known = rows.filter("n > 0 and doc_id is not null")
    grouped = known.groupBy("c0", "c1").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), *[F.min(s).alias(s) for s in SIGNATURE])
    classes = written(grouped, "classes")
    signed = classes.select("id", F.struct("n", *SIGNATURE).alias("signature"))

    keys = chunk_keys(classes)
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    shared = written(keys.join(shared, "key"), "keys")

    # Documents with several texts tie their classes together.
    several = known.groupBy("doc_id").agg(F.min("c0").alias("low"), F.max("c0").alias("high")).filter("low < high").select("doc_id")
    links = [written(known.join(several, "doc_id").join(classes.select("c0", "c1", "id"), ["c0", "c1"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct(), "ties")]
    labels = components(links[0])

    def labelled(frame: DataFrame) -> DataFrame:
        of = labels.select(F.col("node").alias("id"), "component")
        return frame.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))

    for _ in range(2):
        members = labelled(shared)
        smallest = members.groupBy("key").agg(F.min("id").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "pivot")
        pairs = members.select("key", "id", "component").join(smallest, "key").filter("id <> pivot").select("id", "pivot", "component").distinct()
        pairs = labelled(pairs.withColumnRenamed("component", "own").withColumnRenamed("id", "b").withColumnRenamed("pivot", "id")).filter("own <> component")
        pairs = pairs.select(F.col("id").alias("a"), "b")
        pairs = pairs.join(signed.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b").join(signed.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
        # Of several smallest classes the one whose signature is nearest.
        pairs = pairs.filter(alike("x", "y")).groupBy("b").agg(F.min_by("a", F.struct(differing("x", "y"), "a")).alias("a"))
        links.append(written(confirmed(written(pairs, "pairs"), documents), "links"))
        labels = components(reduce(DataFrame.union, links))

    # Pairs of a key in different components: of large keys in blocks of full sets, of others at the first key that they share.
    members = labelled(shared)
    open_keys = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high").select("key", "members")
    members = written(members.join(open_keys, "key"), "members")
    large = members.filter(F.col("members") > LARGE_KEY).select("key", "id", "component")
    if not large.isEmpty():
        links.append(written(links_of_large_keys(large, documents), "links"))
    members = members.filter(F.col("members") <= LARGE_KEY).join(signed, "id")
    left = members.select("key", "at", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("signature").alias("x"))
    right = members.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("signature").alias("y"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike("x", "y") & first_shared("x", "y", "at"))
    links.append(written(confirmed(written(pairs.select("a", "b").distinct(), "pairs"), documents), "links"))
    labels = components(reduce(DataFrame.union, links))

    of_class = labelled(classes.select("c0", "c1", "id")).select("c0", "c1", "component")
    found = rows.select("doc_id", "n", "c0", "c1").join(of_class, ["c0", "c1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are the first of their group, with all their columns."""
    lost = written(near_duplicates(documents).filter(~F.col("kept")).select(F.col("doc_id").alias("lost")).distinct(), "lost")
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    return documents.join(lost, documents["doc_id"] == lost["lost"], "left_anti")


#: ``near_duplicates`` in SQL: all pairs of rows that share a shingle, then everything that can be reached.
SQL = r"""
with recursive d as (
  select row_number() over () as row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (select distinct row, array_to_string(w[k:k + 4], ' ') as shingle from (
  select row, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as k from d)),
n as (select row, count(*) as n from s group by row),
shared as (select a.row as a, b.row as b, count(*) as same from s a join s b on a.shingle = b.shingle and a.row <> b.row group by all),
links as (
  select a, b from shared join n x on x.row = a join n y on y.row = b where 100 * same >= 75 * (x.n + y.n - same)
  union select x.row, y.row from d x join d y on x.doc_id = y.doc_id and x.row <> y.row),
known as (select l.a, l.b from links l join d x on x.row = l.a join d y on y.row = l.b where x.doc_id is not null and y.doc_id is not null),
reach as (
  select row, doc_id as label from d where doc_id is not null
  union select k.b, r.label from reach r join known k on k.a = r.row),
found as (select row, min(label) as component_id from reach group by row)
select doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(doc_id = component_id, true) as kept
from d left join n using (row) left join found using (row)
"""
