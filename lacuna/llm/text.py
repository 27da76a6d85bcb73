"""Whole-column work on Arrow text: bounded blocks, words as byte spans, hashes.

Every function sees the raw UTF-8 bytes of a block of rows at once, so a task
holds a few megabytes of text at a time however long the documents are.
"""

from __future__ import annotations

import contextlib
import ctypes
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text of a block. Each word of it takes part in a dozen arrays of numbers, so a block takes about 100 MB while it is worked on.
BLOCK_BYTES = 4 << 20
#: Bytes hashed at a time: hashing takes about 40 times as much memory.
HASHED_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Odd multipliers of a published 64-bit mixing function and of the word hash.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside its executor's heap, idle or in the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a reused worker keeps from task to task, by operator: a function that empties it.
FORGET: dict[str, Callable[[], None]] = {}


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of text, or one longer row.

    What a worker still keeps for other operators than ``owner`` is given up first.
    """
    for name, forget in FORGET.items():
        if name != owner:
            forget()
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            taken = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, taken + size, side="right")))
            yield batch.slice(first, last - first)
            first = last
        give_back()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the ``n + 1`` row offsets into them; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    kinds = texts.buffers()
    offsets = np.frombuffer(kinds[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(kinds[2], dtype=np.uint8) if kinds[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and for each row (and the end) the words before it."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


class WordHasher:
    """64-bit hashes of byte spans: differences of one running polynomial sum."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans, which are in order and do not overlap; works through the bytes in stretches."""
        out = np.empty(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            low = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, low + HASHED_BYTES, side="right")))
            high = ends[last - 1]
            if len(self.up) < high - low + 1:
                self.up, self.down = _powers(_BASE, int(high - low) + 1), _powers(_BASE_INVERSE, int(high - low) + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * self.up[:high - low], out=sums[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            out[first:last] = mix((sums[b] - sums[a]) * self.down[a])
            first = last
        return out


def spans(data: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    """The texts between consecutive ``bounds``, as indices into the distinct ones."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, offsets, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``pick`` of a ragged array; also their ends in the result."""
    lengths = (offsets[1:] - offsets[:-1])[pick]
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[pick] - (ends - lengths), lengths)
    return values[place], ends


class PartCoder:
    """Token ids of text parts, each distinct part coded once and kept while there is room.

    ``tokenizer`` is a ``tokenizers`` object; parts that match ``single`` go to its model
    alone, as ``show`` writes them.
    """

    def __init__(self, tokenizer, single: str, show: Callable[[str], str], room: int = 250_000):
        self.tokenizer, self.single, self.show, self.room = tokenizer, single, show, room
        self.known: dict[str, bytes] = {}

    def parts(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct part, one after another, and their offsets."""
        single = pc.match_substring_regex(distinct, self.single).to_pylist()
        distinct = distinct.to_pylist()
        if len(self.known) + len(distinct) > self.room:
            self.known.clear()
        known, tokenize, show = self.known, self.tokenizer.model.tokenize, self.show
        found, rest = [known.get(part) for part in distinct], []
        for k, ids in enumerate(found):
            if ids is None:
                part = distinct[k]
                if single[k]:
                    found[k] = known[part] = array("I", [token.id for token in tokenize(show(part))]).tobytes()
                else:
                    rest.append(k)
        coded = self.tokenizer.encode_batch_fast([distinct[k] for k in rest], add_special_tokens=False)
        for k, one in zip(rest, coded):
            found[k] = known[distinct[k]] = array("I", one.ids).tobytes()
        offsets = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum([len(ids) >> 2 for ids in found], out=offsets[1:])
        return np.frombuffer(b"".join(found), dtype=np.uint32), offsets

    def rows(self, data: np.ndarray, bounds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts between ``bounds``, and the offsets in them of the rows at byte ``offsets``."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = spans(data, bounds)
        flat, places = self.parts(coded.dictionary)
        ids, ends = ragged(flat, places, coded.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)]


# Classes of bytes: white space, letters, digits, other ASCII; 0 beyond ASCII.
KIND = np.zeros(256, dtype=np.uint8)
KIND[33:127] = 4
KIND[[*range(65, 91), *range(97, 123)]] = 2
KIND[48:58] = 3
KIND[SPACE] = 1
