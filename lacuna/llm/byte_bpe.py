"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file becomes a ``tokenizers`` model: each byte is written as one printable
character (the byte table), each rank as the merges that make its token. A document
is cut where a character that is no white space meets ASCII white space, and behind
ASCII letters or digits: no match of the pattern crosses such a place, so a cut text
has the ids of its parts. Each distinct part of a block is encoded once, parts that
are one match for sure by the model alone, and the ids are gathered by index.

Offsets come from the bytes of the tokens: together they are the text's bytes, so
running sums place every token, and counting the bytes that begin a character maps
byte places to character places. A token may begin or end inside a character.

Nulls in the text count as an empty text, with no ids. Other columns may be null,
repeated or clash in name: only those asked for are read. Rows stay as they are,
repeated rows included; empty tables give empty results.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from public_tokenizers import PATTERN

from lacuna.llm.text import FORGET, KIND, PartCoder, blocks, raw

# Parts that are a single match of the pattern, whatever the Unicode version.
ONE_MATCH = r"^ ?([A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)$"


def byte_table() -> list[str]:
    """One printable character for each byte: Latin-1's own where it has one, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """A rank file as a ``tokenizers`` model, with the byte table both ways."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        self.to_byte = {char: byte for byte, char in enumerate(table)}
        self.shown = {byte: char for byte, char in enumerate(table) if chr(byte) != char}
        ranks = read_ranks(path)
        shown = lambda token: "".join(table[b] for b in token)
        merges = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if left in ranks and right in ranks:
                    merges.append((rank, cut, shown(left), shown(right)))
        merges.sort(key=lambda m: m[:2])
        vocab = {shown(token): rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab, [m[2:] for m in merges], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        # The way back: characters of the vocabulary to bytes.
        self.bytes_of = {i: bytes(map(self.to_byte.__getitem__, token)) for token, i in vocab.items()}
        self.length_of = np.zeros(max(self.bytes_of, default=-1) + 1, dtype=np.int64)
        for i, token in self.bytes_of.items():
            self.length_of[i] = len(token)
        self.coder = PartCoder(self.tokenizer, ONE_MATCH, self.show)

    def show(self, part: str) -> str:
        """A single match as the model writes it; in ASCII only its space is shown as another character."""
        if part.isascii():
            return part.replace(" ", self.shown[32])
        return part.encode().decode("latin-1").translate(self.shown)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the ``n + 1`` row offsets."""
        data, offsets = raw(texts)
        return self.coder.rows(data, cuts(data, offsets), offsets)

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of the ids; an unknown id raises KeyError."""
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_pieces(self, ids: Sequence[int]) -> Iterator[str]:
        """Text of each id in turn: a split character appears with the id that completes it.

        Bytes that never become a character are replaced by U+FFFD.
        """
        partial = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        for k, i in enumerate(ids):
            yield partial.decode(self.bytes_of[i], final=k == len(ids) - 1)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places, row edges included, where a text may be cut without changing its ids."""
    kind = KIND[data]
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (left != right) & (((right == 1) & (left != 1)) | (((left == 2) | (left == 3)) & (right != 0)))
    wide = np.flatnonzero((left == 0) & cut[1:-1]) + 1
    # White space beyond ASCII, by its last two or three bytes in UTF-8.
    a, b = data[wide - 1], data[wide - 2]
    c = np.where(wide >= 3, data[wide - 3], 0)
    blank = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    blank |= (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    blank |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    blank |= (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    blank |= (c == 0xE3) & (b == 0x80) & (a == 0x80)
    cut[wide[blank]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def model(path: str, pattern: str) -> ByteBpe:
    """One model per worker process."""
    return ByteBpe(path, pattern)


FORGET["byte_bpe"] = model.cache_clear


def character_offsets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of tokens that end at byte places ``ends`` of one text.

    A token that begins inside a character starts at that character.
    """
    seen = np.cumsum((data & 0xC0) != 0x80)
    begins = np.concatenate([[0], ends[:-1]])
    return seen[begins] - 1, seen[ends - 1]


def encode(documents: DataFrame, path: str, pattern: str = PATTERN, offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; with ``offsets`` also ``starts`` and ``ends`` in characters.

    Takes ``doc_id`` and ``text``; null text: no ids.
    """

    def run(batches):
        bpe = model(path, pattern)
        for block in blocks(batches, owner="byte_bpe"):
            texts = block.column("text").fill_null("")
            ids, rows = bpe.encode(texts)
            lists = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32)))]
            if offsets:
                data, bytes_at = raw(texts)
                starts, ends = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
                for k in range(len(texts)):
                    one = slice(rows[k], rows[k + 1])
                    if one.start < one.stop:
                        stops = np.cumsum(bpe.length_of[ids[one]])
                        starts[one], ends[one] = character_offsets(data[bytes_at[k]:bytes_at[k + 1]], stops)
                lists += [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(x)) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"][:1 + len(lists)])

    kind = dict(documents.select("doc_id").dtypes)["doc_id"]
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, bytes, text`` of ``doc_id, ids``; null ids decode to nothing.

    ``text`` has U+FFFD where ids end inside a character.
    """

    def run(batches):
        bpe = model(path, pattern)
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            text = [x.decode("utf-8", "replace") for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(text, pa.string())], ["doc_id", "bytes", "text"])

    kind = dict(encoded.select("doc_id").dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary, text string")


def round_trip(documents: DataFrame, path: str, pattern: str = PATTERN, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, same`` of every row, and ``ids`` if asked for.

    Encodes and decodes in one pass over the text. ``same`` says whether decoding gave
    the text's own bytes.
    """

    def run(batches):
        bpe = model(path, pattern)
        for block in blocks(batches, owner="byte_bpe"):
            texts = block.column("text").fill_null("")
            ids, rows = bpe.encode(texts)
            data, bytes_at = raw(texts)
            wide = ids.astype("<u4")
            hashes, backs, same = [], [], []
            for k in range(len(texts)):
                one = wide[rows[k]:rows[k + 1]]
                back = bpe.decode(one.tolist())
                hashes.append(hashlib.sha256(one.tobytes()).hexdigest())
                backs.append(hashlib.sha256(back).hexdigest())
                same.append(back == data[bytes_at[k]:bytes_at[k + 1]].tobytes())
            more = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(hashes, pa.string()), pa.array(backs, pa.string()), pa.array(same, pa.bool_()), *more],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same", "ids"][:5 + len(more)])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids)
