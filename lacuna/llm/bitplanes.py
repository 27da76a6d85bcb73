"""Token ids in files of bit or byte planes, each compressed by itself, with a chunk index.

A file is one binary value: ``magic, planes of block 0, planes of block 1, ..., chunk
index, footer``. A block holds ``BLOCK_IDS`` ids (the last one fewer). Its ids are
transposed, so that plane k holds the k-th byte (or bit) of every id, and each plane is
a zstandard frame. The chunk index has for each block its first id, count, place, crc32
and plane lengths, so any range of ids is read by decompressing its blocks only.

Files live as rows of a Parquet dataset (``part, seq, n_ids, doc_ids, lengths, content``)
that Spark writes: its commit protocol gives whole datasets on any store and survives
lost executors, which open files written by hand would not. A file ends with a
document; a document longer than a file makes one longer file of many blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.text import KIND, LOWER, SPACE, PartCoder, blocks, raw

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21
MAGIC = b"IDPLANE1"
FOOTER = struct.Struct("<QIBB")  # place of the index, blocks, bytes an id, 1 for bit planes
ENTRY = struct.Struct("<QIQI")  # first id, ids, place, crc32


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block, least significant first."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(rows.shape[1])]
    return [rows[:, k].tobytes() for k in range(rows.shape[1])]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """Ids of a block."""
    if bits:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(rows, axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view(f"<u{width}").reshape(n)


def pack(ids: np.ndarray, width: int = 2, bits: bool = False, level: int = 3) -> bytes:
    """A file of these ids; ids that do not fit ``width`` bytes raise ValueError."""
    import zstandard

    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id of {int(ids.max())} does not fit {width} bytes")
    ids = np.ascontiguousarray(ids, dtype=f"<u{width}")
    press, out, index, at = zstandard.ZstdCompressor(level=level).compress, [MAGIC], [], len(MAGIC)
    for first in range(0, len(ids), BLOCK_IDS):
        block = ids[first:first + BLOCK_IDS]
        planes = [press(p) for p in to_planes(block, bits)]
        index.append(ENTRY.pack(first, len(block), at, zlib.crc32(block.tobytes())) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    return b"".join([*out, *index, FOOTER.pack(at, len(index), width, bits), MAGIC])


class IdFile:
    """Reads a file; raises ValueError where it is cut short or a block's checksum differs."""

    def __init__(self, content: bytes):
        import zstandard

        tail = FOOTER.size + len(MAGIC)
        if len(content) < tail + len(MAGIC) or content[:len(MAGIC)] != MAGIC or content[-len(MAGIC):] != MAGIC:
            raise ValueError("not a whole file of id planes")
        self.content, self.unpress = content, zstandard.ZstdDecompressor().decompress
        at, n, self.width, self.bits = FOOTER.unpack_from(content, len(content) - tail)
        planes = self.width * (8 if self.bits else 1)
        step = ENTRY.size + 4 * planes
        self.index = [ENTRY.unpack_from(content, at + k * step) + struct.unpack_from(f"<{planes}I", content, at + k * step + ENTRY.size) for k in range(n)]

    def __len__(self) -> int:
        return self.index[-1][0] + self.index[-1][1] if self.index else 0

    def block(self, k: int) -> np.ndarray:
        _, n, at, crc, *lengths = self.index[k]
        planes = []
        for length in lengths:
            planes.append(self.unpress(self.content[at:at + length]))
            at += length
        ids = from_planes(planes, n, self.width, bool(self.bits))
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def read(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``first + count``, from the blocks that hold them."""
        last = len(self) if count is None else min(len(self), first + count)
        if first >= last:
            return np.zeros(0, f"<u{self.width}")
        low, high = first // BLOCK_IDS, (last - 1) // BLOCK_IDS
        return np.concatenate([self.block(k) for k in range(low, high + 1)])[first - low * BLOCK_IDS:last - low * BLOCK_IDS]


# Parts that are a single piece before the merges and that normalising leaves alone.
ONE_PIECE = r"^([a-zà-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+)$"


class WordBpe:
    """A lower-casing word tokenizer that drops white space, applied to distinct parts of a block.

    White space ends every piece, and so does the end of a run of ASCII letters or a
    digit before other ASCII; normalising acts within such parts. So a text has the
    ids of its parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from lacuna.llm.byte_bpe import byte_table

        self.tokenizer = Tokenizer.from_file(path)
        ordinary = Tokenizer.from_file(path)
        ordinary.encode_special_tokens = True  # no part holds their strings: texts are cut there
        special = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items() if token.special}
        self.special, self.borders = special, re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        shown = {byte: char for byte, char in enumerate(byte_table()) if chr(byte) != char}
        self.coder = PartCoder(ordinary, ONE_PIECE, lambda p: p if p.isascii() else p.encode().decode("latin-1").translate(shown))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the ``n + 1`` row offsets.

        The string of a special token in a text is that token, as the library has it; what lies
        between such strings is encoded by itself.
        """
        holds = np.zeros(len(texts), dtype=bool)
        for string in self.special:
            holds |= pc.match_substring(texts, string).fill_null(False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._ordinary(texts)
        pieces, counts = [], []  # by turns text and special string; a row begins and ends with text
        for text, cut in zip(texts.to_pylist(), holds):
            own = self.borders.split(text) if cut else [text]
            pieces += own
            counts.append(len(own))
        flat, offsets = self._ordinary(pa.array([None if p in self.special else p for p in pieces], pa.large_string()))
        where = [k for k, p in enumerate(pieces) if p in self.special]
        ids = np.insert(flat, offsets[where], [self.special[pieces[k]] for k in where])
        lengths = np.diff(offsets)
        lengths[where] = 1
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(texts)
        solid = ~SPACE[data]
        start = np.zeros(len(data) + 1, dtype=bool)
        start[1:-1] = ~solid[:-1]
        start[offsets] = True
        place = np.concatenate([[0], np.cumsum(solid)])[offsets]
        start = start[:-1][solid]
        data = LOWER[data[solid]]
        kind = KIND[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[:-1] = start
        cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0) & ((kind[:-1] == 2) | (kind[:-1] == 3))
        cut[place] = True
        return self.coder.rows(data, np.flatnonzero(cut), place)


@lru_cache(maxsize=2)
def word_model(path: str) -> WordBpe:
    """One model per worker process."""
    return WordBpe(path)


def write_ids(documents: DataFrame, path: str, end_id: int, folder: str, parts: int | None = None, bits: bool = False) -> None:
    """Write the ids of all texts to ``folder``, in ascending ``doc_id`` order.

    Every text (null: empty) is encoded by the tokenizer at ``path`` and ends with
    ``end_id``. Rows of one id lie side by side, in the order of a hash of their text; null
    ids come first; extra columns are not read. The order is by range partitions, so no task holds more than
    its range, and equal ids may span ranges.
    """
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        bpe, part = word_model(path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        seq = count = 0

        def file():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(ids, bpe.width, bits)], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "lengths", "content"])

        for block in blocks(batches):
            ids, rows = bpe.encode(block.column("text"))
            ends = np.insert(ids, rows[1:], end_id).astype(f"<u{bpe.width}")
            rows = rows + np.arange(len(rows))
            docs, first = block.column("doc_id").to_pylist(), 0
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(rows, rows[first] + FILE_IDS - count, side="right")) - 1)
                held.append(ends[rows[first]:rows[last]])
                names += docs[first:last]
                lengths += np.diff(rows[first:last + 1]).tolist()
                count += int(rows[last] - rows[first])
                first = last
                if count >= FILE_IDS or first < len(docs):
                    yield file()
                    held, names, lengths, count, seq = [], [], [], 0, seq + 1
        if names:
            yield file()

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    (rows.repartitionByRange(parts, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "text").mapInArrow(run, "part int, seq int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, content binary")
     .write.option("compression", "none").parquet(folder))


def file_bases(files: DataFrame) -> DataFrame:
    """``part, seq, base``: the ids before each file.

    Sums go by part first, so the one ordered task holds a row for each range partition.
    """
    sizes = files.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))


def read_ids(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the unsigned
    crc32 of its ids, the end id included, as little-endian unsigned 32-bit integers.
    """
    files = spark.read.parquet(folder)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                names, lengths = batch.column("doc_ids")[row].values, batch.column("lengths")[row].values.to_numpy()
                ids = IdFile(batch.column("content")[row].as_py()).read().astype("<u4")
                ends = np.cumsum(lengths)
                if (ends[-1] if len(ends) else 0) != len(ids):
                    raise ValueError("a file's documents do not cover its ids")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(c)[row], n) for c in ("part", "seq")] + [names, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "doc_ids", "lengths", "content").mapInArrow(
        run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(file_bases(files), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
