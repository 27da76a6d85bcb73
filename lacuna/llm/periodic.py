"""Periodic runs of words: harmonic grids over a recompression grammar.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and
``TIMES * q`` long, that no neighbouring word extends. For a period p the places p apart
from the start of a text form a grid; a run of three periods holds three places of it, so
two neighbouring places with equal words are candidates. The grammar's exact extensions
to both sides give the whole stretch. All grids of a text together have n (1 + 1/2 +
1/3 + ...) places. The smallest period found for a stretch is its smallest period: a run
with period q is found by the grids of its multiples too, with the same bounds.

Texts are worked on in blocks of about ``BLOCK`` bytes with one grammar for each block, or
one text if it is longer: a task takes memory in proportion to its longest text.

Words are what ASCII white space separates. A null text has none. A word is dropped if a
run contains it after the run's first q words. Repeated rows and ids are each judged
alone, a null doc_id is kept, extra columns are not read, empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.grammar import Grammar
from lacuna.llm.text import blocks, give_back

LEAST, TIMES = 24, 3
BLOCK = 1 << 20
#: Places of grids looked at together.
PLACES = 1 << 19


def candidates(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Neighbouring places ``a, a + p`` of all grids with the same symbols there and next to them, in portions of ``a, p``.

    A text of n words has the periods up to ``n // TIMES``. From the first place of a grid in
    a run at least p + 1 further words agree, so looking at the next one loses nothing.
    """
    long = sizes >= LEAST
    starts, sizes = starts[long], sizes[long]
    periods = sizes // TIMES
    ends = np.cumsum(periods)
    owner = np.repeat(np.arange(len(starts)), periods)
    period = np.arange(len(owner)) - np.repeat(ends - periods, periods) + 1
    places = (sizes[owner] - 1) // period  # a = k p with a + p inside
    upto = np.cumsum(places)
    first = 0
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PLACES, side="right")))
        n, p = places[first:last], period[first:last]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        a = np.repeat(starts[owner[first:last]], n) + k * p
        same = (symbols[a] == symbols[a + p]) & (symbols[a + 1] == symbols[a + p + 1])
        yield a[same], p[same]
        first = last


def runs(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs, in order; text k has ``symbols[offsets[k]:offsets[k + 1]]``, all positive."""
    sizes = np.diff(offsets)
    n = len(sizes)
    bordered = np.zeros(len(symbols) + n + 1, dtype=np.int64)  # a border before each text and behind the last
    starts = offsets[:-1] + np.arange(1, n + 1)
    bordered[np.arange(len(symbols)) + np.repeat(np.arange(1, n + 1), sizes)] = symbols
    grammar, found = None, []
    for a, p in candidates(bordered, starts, sizes):
        if not len(a):
            continue
        grammar = grammar or Grammar(bordered)
        reach = grammar.extend(a, a + p)
        far = reach > p  # so it is at the first place of a grid in a run
        a, p, right = a[far], p[far], (a + p + reach)[far]
        left = a + 1 - grammar.extend_back(a, a + p)
        enough = right - left >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.column_stack([left, right, p])[enough], axis=0))
    table = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    fresh = np.ones(len(table), dtype=bool)
    fresh[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)  # the smallest period of each stretch
    left, right, period = table[fresh].T
    text = np.searchsorted(starts, left, side="right") - 1
    return text, left - starts[text], right - left, period


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, their numbers (equal words have equal ones, from 1) and the offsets of the texts."""
    own = [text.split() if text else [] for text in texts.cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in own], out=offsets[1:])
    flat = [word for some in own for word in some]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    return flat, coded.indices.to_numpy().astype(np.int64) + 1, offsets


def periodic_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``doc_id, text``.

    ``runs``: structs of start, length and period (in words, from 0) by start, then period;
    ``collapsed``: the words that no run drops, joined by one space.
    """

    def run(batches):
        for block in blocks(batches, size=BLOCK):
            flat, symbols, offsets = split_words(block.column("text"))
            text, start, length, period = runs(symbols, offsets)
            drop = np.zeros(len(flat) + 1, dtype=np.int64)
            np.add.at(drop, offsets[text] + start + period, 1)
            np.add.at(drop, offsets[text] + start + length, -1)
            keep = np.cumsum(drop)[:-1] == 0
            untouched = np.logical_and.reduceat(np.append(keep, True), np.minimum(offsets[:-1], len(keep))) if block.num_rows else keep
            collapsed = []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = flat[a:b] if a == b or untouched[k] else [flat[i] for i in np.flatnonzero(keep[a:b]) + a]
                collapsed.append(b" ".join(own))
            order = np.lexsort((period, start, text))
            structs = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(block.num_rows + 1)).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
            del flat, symbols, collapsed
            give_back()

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
