"""Line dedup by log templates: a tree of fixed depth finds lines that differ in variable fields.

A line is its tokens between white space; a token with a digit is a variable field from
the start, ``<*>``. The tree sorts lines by their number of tokens and then by their
first ``DEPTH`` tokens. In a leaf with different lines of several documents the tokens
of each further place are counted, a line once for each document that has it: a token
that holds more than half of the count is constant there, any other place is a variable
field. That is the leaf's template if at least ``CONSTANT`` of its places are constant,
and the lines that agree with all of them fall under it. Every other line is a template
of its own. So lines that only start alike stay apart, and the result does not depend on
the order of rows.

A template found in ``MIN_DOCUMENTS`` documents or more recurs: its lines stay in the
document with the smallest doc_id and are dropped from the others, so no passage is lost
for good. Lines of fewer than ``MIN_TOKENS`` tokens say too little; they stay.

Nulls: a null text stays null and has no lines; a null doc_id counts as one document,
after all others. Rows that repeat a doc_id are one document: what they share does not
recur by that. Empty texts and tables stay empty. Other columns pass through
``clean``; they may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import written
from lacuna.llm.text import WordHasher, blocks, mix, raw, words

DEPTH = 4
MIN_TOKENS = 3
MIN_DOCUMENTS = 2
CONSTANT = 60  # per cent of a template's places
#: Sets of lines are broadcast up to so many rows, and joined by shuffling beyond.
BROADCAST_ROWS = 1_000_000
#: Bytes of text of a block: lines, tokens and what is kept of them are held beside it.
BLOCK = 2 << 20
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1

_FIELD = np.frombuffer(b"<*>", np.uint8)
_STEP = np.uint64(0xA0761D6478BD642F)
_LENGTH = np.uint64(0xE7037ED1A0B428DB)


class Lines:
    """All lines of a block of texts: their bytes, rows, tokens and hashes."""

    def __init__(self, texts: pa.Array, hasher: WordHasher):
        self.data, self.offsets = raw(texts)
        breaks = np.flatnonzero(self.data == 10)
        rows = len(self.offsets) - 1
        # A line ends at a break or at the end of its text.
        ends = np.concatenate([breaks, self.offsets[1:]])
        of = np.concatenate([np.searchsorted(self.offsets, breaks, side="right") - 1, np.arange(rows)])
        order = np.lexsort((ends, of))
        self.ends, self.row = ends[order], of[order]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.starts[self.first[:-1]] = self.offsets[:-1]
        starts, stops, _ = words(self.data, self.offsets)
        digits = np.concatenate([[0], np.cumsum((self.data >= 48) & (self.data <= 57))])
        self.token = hasher(self.data, starts, stops)
        field = hasher(_FIELD, np.array([0]), np.array([3]))[0]
        self.token[digits[stops] > digits[starts]] = field
        self.begin = np.searchsorted(starts, self.starts)
        self.n = np.searchsorted(starts, self.ends) - self.begin
        place = np.arange(len(starts)) - np.repeat(self.begin, self.n)
        powers = np.full(int(self.n.max(initial=0)) + 1, _STEP, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        weighed = self.token * powers[place]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed)])
        size = self.n.astype(np.uint64) * _LENGTH
        last = self.begin + self.n
        self.line = mix(upto[last] - upto[self.begin] + size)
        self.leaf = mix(upto[np.minimum(last, self.begin + DEPTH)] - upto[self.begin] + size + np.uint64(1))

    def parsed(self) -> np.ndarray:
        """Lines with enough tokens."""
        return np.flatnonzero(self.n >= MIN_TOKENS)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def parsed_lines(documents: DataFrame) -> DataFrame:
    """``id, line, leaf`` for every line with enough tokens, equal ones of a row once; ``line`` and ``leaf`` are hashes."""

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches, size=BLOCK):
            found = Lines(block.column("text"), hasher)
            kept = found.parsed()
            ids = block.column("id").to_numpy()[found.row[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), _signed(found.line[kept]), _signed(found.leaf[kept])], ["id", "line", "leaf"])

    return documents.select("id", "text").mapInArrow(run, "id long, line long, leaf long")


def line_tokens(wanted: DataFrame) -> DataFrame:
    """``leaf, line, documents, n, place, token`` for the lines that each row of ``text, lines, counts`` asks for."""

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches, size=BLOCK):
            found = Lines(block.column("text"), hasher)
            asked, counts = block.column("lines"), block.column("counts")
            picks, weights = [], []
            for r in range(block.num_rows):
                own = slice(found.first[r], found.first[r + 1])
                lines, where = np.unique(found.line[own], return_index=True)
                names = asked[r].values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(lines, names), max(0, len(lines) - 1))
                hit = lines[at] == names if len(lines) else np.zeros(len(names), bool)
                picks.append(where[at[hit]] + own.start)
                weights.append(counts[r].values.to_numpy()[hit])
            picked = np.concatenate(picks) if picks else np.zeros(0, np.int64)
            n = found.n[picked]
            ends = np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            repeat = lambda x: np.repeat(x, n)
            yield pa.RecordBatch.from_arrays(
                [_signed(repeat(found.leaf[picked])), _signed(repeat(found.line[picked])), pa.array(repeat(np.concatenate(weights) if weights else np.zeros(0, np.int64))),
                 pa.array(repeat(n).astype(np.int64)), pa.array(place.astype(np.int64)), _signed(found.token[repeat(found.begin[picked]) + place])],
                ["leaf", "line", "documents", "n", "place", "token"])

    return wanted.select("text", "lines", "counts").mapInArrow(run, "leaf long, line long, documents long, n long, place long, token long")


def small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def dropped_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``id, line``: the lines (as hashes) that each document of ``id, text`` loses."""
    lines = written(parsed_lines(documents).distinct(), "lines")
    kinds = written(lines.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"), F.max("id").alias("last")), "kinds")

    # Leaves with different lines of several documents may have a template of their own.
    leaves = kinds.groupBy("leaf").agg(F.sum("documents").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high"))
    leaves = leaves.filter("kinds > 1 and low < high").select("leaf", "total")
    wanted = written(kinds.join(leaves, "leaf").select("first", "line", "documents"), "wanted")
    asked = wanted.groupBy(F.col("first").alias("id")).agg(F.collect_list(F.struct("line", "documents")).alias("x")).select("id", F.col("x.line").alias("lines"), F.col("x.documents").alias("counts"))
    tokens = line_tokens(documents.join(small(asked, wanted.count()), "id")).distinct()
    tokens = written(tokens, "tokens")
    counted = tokens.groupBy("leaf", "place", "token").agg(F.sum("documents").alias("held"))
    constant = counted.join(leaves, "leaf").filter("2 * held > total").select("leaf", "place", "token")
    constant = written(constant, "constant")
    per_leaf = constant.groupBy("leaf").agg(F.count(F.lit(1)).alias("constants"))
    agreeing = tokens.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "line", "n").agg(F.count(F.lit(1)).alias("agreeing"))
    under = agreeing.join(per_leaf, "leaf").filter(f"agreeing = constants and 100 * constants >= {CONSTANT} * n").select("line", "leaf", F.lit(True).alias("general"))

    # A line's template: its leaf's, or the line itself.
    named = kinds.join(under, ["line", "leaf"], "left").select("line", F.when(F.col("general"), F.col("leaf")).otherwise(F.col("line")).alias("template"), F.coalesce("general", F.lit(False)).alias("general"), "first", "last")
    recurring = named.groupBy("template", "general").agg(F.min("first").alias("keeper"), F.max("last").alias("latest")).filter("keeper < latest")
    if min_documents > 2:
        spread = lines.join(named.select("line", "template", "general"), "line").select("id", "template", "general").distinct()
        often = spread.groupBy("template", "general").count().filter(F.col("count") >= min_documents).select("template", "general")
        recurring = recurring.join(often, ["template", "general"])
    losing = written(named.join(recurring, ["template", "general"]).select("line", "keeper"), "losing")
    return lines.join(losing, "line").filter("id <> keeper").select("id", "line")


def clean(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All columns of ``documents``, with ``text`` freed of recurring lines, and ``n_lines, n_dropped``.

    Columns of those two names in the input are replaced.
    """
    others = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text"))
    drops = written(dropped_lines(keyed, min_documents), "drops")
    sets = small(drops.groupBy("id").agg(F.collect_list("line").alias("lines")), drops.count())
    nested = documents.select(F.struct(*[F.col(f"`{c}`") for c in others if c != "text"]).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    joined = nested.join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("row", "text", "lines")

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches, size=BLOCK):
            texts, drop = block.column("text"), block.column("lines")
            found = Lines(texts, hasher)
            given, n_lines, n_dropped = texts.is_valid().to_pylist(), np.diff(found.first), np.zeros(block.num_rows, np.int64)
            out = []
            for r in range(block.num_rows):
                own = slice(found.first[r], found.first[r + 1])
                whole = found.data[found.offsets[r]:found.offsets[r + 1]].tobytes()
                if drop[r].is_valid:
                    lost = np.isin(found.line[own], drop[r].values.to_numpy().view(np.uint64)) & (found.n[own] >= MIN_TOKENS)
                    n_dropped[r] = lost.sum()
                    whole = b"\n".join([found.data[a:b].tobytes() for a, b, x in zip(found.starts[own], found.ends[own], lost) if not x])
                out.append(whole.decode() if given[r] else None)
            n_lines = np.where(given, n_lines, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(out, pa.string()), pa.array(n_lines), pa.array(n_dropped)], ["row", "text", "n_lines", "n_dropped"])

    schema = joined.select("row", "text").schema.add("n_lines", "long").add("n_dropped", "long")
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in others], "n_lines", "n_dropped")


#: The same rules in SQL; tokens are compared as text instead of by their hashes.
SQL = rf"""
with d as (
  select row_number() over () as row, doc_id, coalesce(doc_id, {NO_ID}) as id, text, string_split(text, chr(10)) as lines from documents),
u as (select row, id, generate_subscripts(lines, 1) as k, unnest(lines) as raw from d),
p as (
  select row, id, k, raw,
    list_transform(list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
                   lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as line from u),
l as (select *, len(line) as n, struct_pack(n := len(line), head := line[1:{DEPTH}]) as leaf from p where len(line) >= {MIN_TOKENS}),
kinds as (select line, leaf, n, count(distinct id) as documents, min(id) as first, max(id) as last from l group by all),
leaves as (
  select leaf, sum(documents) as total from kinds group by leaf having count(*) > 1 and min(first) < max(last)),
tokens as (
  select leaf, line, n, documents, generate_subscripts(line, 1) as place, unnest(line) as token from kinds semi join leaves using (leaf)),
constant as (
  select leaf, place, token from tokens join leaves using (leaf) group by leaf, place, token, total having 2 * sum(documents) > total),
per_leaf as (select leaf, count(*) as constants from constant group by leaf),
under as (
  select leaf, line from tokens join constant using (leaf, place, token) join per_leaf using (leaf)
  group by leaf, line, n, constants having count(*) = constants and 100 * constants >= {CONSTANT} * n),
named as (
  select k.line, k.leaf, first, last, under.line is not null as general,
    case when under.line is not null then null else k.line end as own
  from kinds k left join under on k.line = under.line and k.leaf = under.leaf),
recurring as (
  select case when general then leaf end as of_leaf, own, general, min(first) as keeper from named group by all having min(first) < max(last)),
losing as (
  select line, keeper from named join recurring r on named.general = r.general and named.own is not distinct from r.own
    and (case when named.general then leaf end) is not distinct from r.of_leaf),
kept as (
  select u.row, u.k, u.raw, coalesce(l.id <> losing.keeper, false) as lost
  from u left join l on u.row = l.row and u.k = l.k left join losing on l.line = losing.line),
merged as (
  select row, count(*) as n_lines, count(*) filter (where lost) as n_dropped, coalesce(string_agg(raw, chr(10) order by k) filter (where not lost), '') as cleaned
  from kept group by row)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, case when text is not null then cleaned end as text
from d left join merged using (row)
"""
