"""Sharding by sampled splitters: near-equal bytes over ranges of an ordered key.

Rows are ordered by the md5 of their text, then by ``doc_id``, so equal texts lie side by
side. A size-weighted sample of keys gives splitters at its quantiles, which cut that
order into many more ranges than shards. Ranges are counted; a range with more than twice
its share of rows is cut again at quantiles of a sample of its own (the key ends with a
row's place, so even a text that a third of all rows repeat can be cut). Running sums of
the range sizes place each range, a running sum inside a range places its rows, and a row
goes to the shard in which its middle byte lies: shards differ by about a row's size,
whatever the sample was.

Only DataFrame functions are used. The driver sees the sampled keys and one row for each
range, both bounded by ``MAX_RANGES``; beyond that many rows ranges grow, not the driver.

A null text has no bytes, the crc32 of an empty text and the key of one. A null ``doc_id``
sorts first. Repeated rows each get a slot of their own. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.frames import local_frame
from lacuna.llm.storage import written

#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Rows a range should hold, the bounds of the number of ranges, and sampled keys for each range.
RANGE_ROWS = 200_000
MIN_RANGES, MAX_RANGES = 192, 4096
SAMPLE_A_RANGE = 16
SECOND_CUTS = 6


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted ``splitters`` lie at or below ``key``: first among every 64th, then among the 64."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    parts = [splitters[i:i + step] for i in range(0, len(splitters), step)]
    below = lambda array: F.size(F.filter(array, lambda s: s <= key))
    part = below(F.array(*[F.lit(p[0]) for p in parts]))
    fine = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    return F.when(part == 0, 0).otherwise((part - 1) * step + below(F.element_at(fine, F.greatest(part, F.lit(1)))))


def sampled_splitters(rows: DataFrame, pieces: dict[int, int], total: dict[int, int]) -> list[str]:
    """Keys at equal weights of a size-weighted sample of ``rows`` (``range, key, size``).

    ``pieces``: into how many parts each range is to be cut; ``total``: its bytes. A row
    is drawn when a hash of its key falls below its share; one so large that it is
    certain to be drawn counts for all the draws it stands for.
    """
    spark = rows.sparkSession
    wanted = local_frame(spark, [(r, n * SAMPLE_A_RANGE / max(1, total[r])) for r, n in pieces.items()], "range int, rate double")
    share = F.col("size") * F.col("rate")
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.join(F.broadcast(wanted), "range").filter(draw < share).select("range", "key", F.greatest(share, F.lit(1.0)).alias("weight"))
    out: list[str] = []
    found: dict[int, list[tuple[str, float]]] = {}
    for row in drawn.collect():
        found.setdefault(row["range"], []).append((row["key"], row["weight"]))
    for r, sample in found.items():
        sample.sort()
        whole, upto, step = sum(w for _, w in sample), 0.0, 1
        for key, weight in sample:
            upto += weight
            if upto >= whole * step / pieces[r] and step < pieces[r]:
                out.append(key)
                step = int(upto * pieces[r] / whole) + 1
    return sorted(set(out))


def sizes_of(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each range."""
    found = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    return {r["range"]: (r["n"], r["bytes"]) for r in found}


def shard_by_bytes(documents: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; slots are gapless from 0 in each shard."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(text.cast("binary")), F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long")), 16, "0"), F.lit("")),
                 F.lit("/"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("key"),
    )
    rows = written(rows, "keys")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    if not whole["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n, total = whole["n"], whole["bytes"]
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-n // RANGE_ROWS)))
    placed = rows.withColumn("range", F.lit(0))
    cuts, sizes, pieces = [], {0: (n, total)}, {0: ranges}
    for _ in range(SECOND_CUTS):
        inside = placed.filter(F.col("range").isin(list(pieces))) if len(pieces) < len(sizes) else placed
        cuts = sorted({*cuts, *sampled_splitters(inside, pieces, {r: sizes[r][1] for r in pieces})})
        placed = rows.withColumn("range", range_of(F.col("key"), cuts))
        sizes = sizes_of(placed)
        pieces = {r: -(-k * ranges // n) for r, (k, _) in sizes.items() if k > max(64, 2 * n // ranges)}
        if not pieces:
            break

    # Ranges without a shard's edge inside are counted here, the few others by their rows.
    edges = [-(-total * s // shards) for s in range(1, shards)]  # a shard's first byte
    table, split, held, at_row, at_byte = [], [], dict.fromkeys(range(shards), 0), 0, 0
    for r in sorted(sizes):
        k, size = sizes[r]
        table.append((r, at_row, at_byte))
        shard = bisect_right(edges, at_byte)
        if shard == bisect_right(edges, at_byte + size):
            held[shard] += k
        else:
            split.append(r)
        at_row, at_byte = at_row + k, at_byte + size
    bases = F.broadcast(local_frame(spark, table, "range int, row_base long, byte_base long"))  # a row for each range

    def sharded(part: DataFrame) -> DataFrame:
        order = Window.partitionBy("range").orderBy("key")
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return (
            part.join(bases, "range")
            .withColumn("middle", 2 * (F.col("byte_base") + upto) - F.col("size"))
            .withColumn("row", F.col("row_base") + F.row_number().over(order) - 1)
            .withColumn("shard", F.expr(f"cast(least({shards - 1}, (middle * {shards}) div {2 * total}) as int)"))
        )

    if split:
        for r in sharded(placed.filter(F.col("range").isin(split))).groupBy("shard").count().collect():
            held[r["shard"]] += r["count"]
    firsts = [sum(held[s] for s in range(shard)) for shard in range(shards)]
    slot = F.col("row") - F.element_at(F.array(*[F.lit(x).cast("long") for x in firsts]), F.col("shard") + 1)
    return sharded(placed).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


#: ``shard_by_bytes`` in SQL, with a table-driven crc32: rows in key order, each in the shard of its middle byte.
SQL = r"""
with crc_table as (
  select list(list_reduce(list_prepend(b::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from range(256) r(b)),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
s as (
  select row, doc_id, md5(text) as key, cast(octet_length(encode(text)) + {row_bytes} as bigint) as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from d, crc_table),
o as (select *, sum(size) over (order by key, doc_id is not null, doc_id < 0, doc_id, row) as upto, sum(size) over () as total from s),
p as (select *, cast(least({shards} - 1, ((2 * upto - size) * {shards}) // (2 * total)) as int) as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key, doc_id is not null, doc_id < 0, doc_id, row) - 1 as slot,
  cast(null as int) as grown_shard
from p
""".replace("{row_bytes}", str(ROW_BYTES)).replace("{shards}", "24")
