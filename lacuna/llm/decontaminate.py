"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become tokens: lower-cased runs of letters and digits. A document is contaminated
by an item if, at some alignment, ``WINDOW`` consecutive tokens of both agree in all but
``SUBSTITUTIONS`` places. Fixed masks pick the tokens of a position that are hashed and
ignore the others; the masks are such that every window with at most that many
substitutions has a place where one of them sees agreeing tokens only. So joining the
hashes of all positions of documents and items misses no overlap, and each hit is then
verified token by token along its alignment.

An item of fewer than ``WINDOW`` tokens has to occur whole and without substitutions;
for such lengths, of at least ``LEAST_TOKENS``, a mask of just that length is added.
Shorter items say too little and match nothing.

Null texts have no tokens. A null item_id is an item like others; repeated items count
once. A null doc_id is returned as it is. Rows that repeat a doc_id are judged each by
its own text. Empty tables and an empty benchmark give no contamination. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import written

WINDOW, SUBSTITUTIONS = 13, 2
LEAST_TOKENS = 5
#: Every way to put 2 substitutions into 13 tokens leaves a place where one of these sees none.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
BETWEEN = r"[^\p{L}\p{N}]+"
#: A table of item hashes or of hits is broadcast up to so many rows, and joined by shuffling beyond.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def small(frame: DataFrame) -> DataFrame:
    """``frame`` (a written table), marked for broadcasting if its counted rows allow."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def seeded(frame: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row ``seed, place`` for each mask and place of the hashes ``h`` where it fits, beside the other columns."""
    def of(k: int, mask: tuple[int, ...]) -> Column:
        count = F.size("h") - mask[-1]
        seed = lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get("h", i + m) for m in mask]).alias("seed"), i.alias("place"))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), seed)).otherwise(F.array().cast("array<struct<seed:bigint,place:int>>"))

    others = [c for c in frame.columns if c != "h"]
    return frame.select(*others, F.inline(F.concat(*[of(k, mask) for k, mask in enumerate(masks)])))


def verified(frame: DataFrame) -> DataFrame:
    """Most agreeing tokens in a window along ``shift``, or null where that is not enough: ``best``.

    ``words`` and ``item`` are the tokens of the document and of the item; token k of the
    item lies at place k + shift of the document. No filter here: pushed down it would
    copy these columns into each other and compute them once for every use.
    """
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item"), F.size("words") - F.col("shift"))
    frame = frame.withColumn("same", F.when(high > low, F.transform(
        F.sequence(low, high - 1), lambda k: (F.get("item", k) == F.get("words", k + F.col("shift"))).cast("int"))).otherwise(F.array().cast("array<int>")))
    span = F.least(F.lit(WINDOW), F.size("item"))
    needed = F.when(F.size("item") >= WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.size("item"))
    frame = frame.withColumn("span", span).withColumn("needed", needed)
    # Sums of windows as differences of running sums.
    upto = F.aggregate("same", F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    frame = frame.withColumn("upto", upto)
    windows = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("span")), lambda k: F.get("upto", k + F.col("span")) - F.get("upto", k))
    frame = frame.withColumn("most", F.when(F.size("same") >= F.col("span"), F.array_max(windows)).otherwise(0))
    return frame.withColumn("best", F.when(F.col("most") >= F.col("needed"), F.col("most")))


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``id, key, n_items, best`` for the contaminated ``doc_id``s and hashes of their text."""
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).filter(F.size("item") >= LEAST_TOKENS).distinct()
    items = written(items, "items")
    short = tuple(tuple(range(r["n"])) for r in items.select(F.size("item").alias("n")).filter(F.col("n") < WINDOW).distinct().orderBy("n").collect())
    masks = MASKS + short
    seeds = seeded(items.select("item_id", "item", hashed(F.col("item")).alias("h")), masks)
    seeds = small(written(seeds.withColumnRenamed("place", "item_place"), "seeds"))

    texts = keyed(documents).select("doc_id", "text", "text_key")
    found = seeded(texts.select("text_key", hashed(tokens(F.col("text"))).alias("h")), masks).join(seeds.select("seed", "item_id", "item_place", "item"), "seed")
    hits = found.select("text_key", "item_id", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = small(written(hits, "hits"))

    pairs = texts.join(hits, "text_key").withColumn("words", tokens(F.col("text")))
    judged = verified(pairs).groupBy("doc_id", "text_key", "item_id").agg(F.max("best").alias("best")).filter("best is not null")
    judged = judged.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).cast("long").alias("n_items"), F.max("best").cast("long").alias("best"))
    return judged.withColumnsRenamed({"doc_id": "id", "text_key": "key"})


def keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``text_key``, a hash of the text; an input column of that name is replaced."""
    return documents.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, best`` for every row of ``documents`` (``doc_id, text``).

    ``benchmark`` has ``item_id, text``. ``n_items``: items that contaminate the document;
    ``best``: most agreeing tokens in a window (0 if clean).
    """
    rows = keyed(documents).select("doc_id", "text_key")
    judged = overlaps(documents, benchmark)
    out = rows.join(judged, rows["doc_id"].eqNullSafe(judged["id"]) & (rows["text_key"] == judged["key"]), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("best", zero).alias("best"))


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that no item contaminates, with all their columns."""
    rows, judged = keyed(documents), small(written(overlaps(documents, benchmark), "overlaps"))
    clean = rows.join(judged, rows["doc_id"].eqNullSafe(judged["id"]) & (rows["text_key"] == judged["key"]), "left_anti")
    return clean.select(*documents.columns)


#: The definition without seeds: every pair of equal tokens, counted along alignments.
SQL = rf"""
with d as (
  select doc_id, row_number() over () as row, list_filter(regexp_split_to_array(lower(text), '{BETWEEN}'), lambda x: x <> '') as words from documents),
dw as (select row, len(words) as n, generate_subscripts(words, 1) as p, unnest(words) as w from d),
i as (
  select distinct item_id, list_filter(regexp_split_to_array(lower(text), '{BETWEEN}'), lambda x: x <> '') as item from benchmark),
iw as (
  select row_number() over () as irow, item_id, item from i where len(item) >= {LEAST_TOKENS}),
iu as (select irow, item_id, len(item) as m, generate_subscripts(item, 1) as q, unnest(item) as w from iw),
same as (
  select row, irow, item_id, n, m, p - q as shift, p from dw join iu using (w)),
aligned as (
  select row, irow, shift from same
  group by row, irow, shift, n, m
  having count(*) >= case when m >= {WINDOW} then {WINDOW - SUBSTITUTIONS} else m end
     and least(n, m + shift) - greatest(0, shift) >= least(m, {WINDOW})),
windows as (
  select row, item_id, m,
    count(*) over (partition by row, irow, shift order by p range between current row and {WINDOW - 1} following) as best
  from same semi join aligned using (row, irow, shift)),
judged as (
  select row, count(distinct coalesce(cast(item_id as varchar), '')) as n_items, max(best) as best from windows
  where best >= case when m >= {WINDOW} then {WINDOW - SUBSTITUTIONS} else m end group by row)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, coalesce(best, 0) as best
from d left join judged using (row)
"""
