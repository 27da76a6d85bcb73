"""Encoding against the libraries themselves, round trips, and the id files."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from helpers import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import bitplanes, byte_bpe, storage

RANKS = public.path("byte_bpe_multi_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")
TEXTS = st.lists(st.text(st.one_of(st.sampled_from(" \n\t' 　\u0085ab1é!sİßΣ́"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def rows_of(encoded):
    ids, rows = encoded
    return [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_byte_bpe_is_the_libraries(texts, reference):
    bpe = byte_bpe.model(RANKS, public.PATTERN)
    found = rows_of(bpe.encode(pa.array(texts)))
    assert found == [reference.encode_ordinary(t) for t in texts]
    for text, ids in zip(texts, found):
        assert bpe.decode(ids) == text.encode()
        assert "".join(bpe.decode_pieces(ids)) == text


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_word_bpe_is_the_libraries(texts):
    fresh = Tokenizer.from_file(WORDS)
    assert rows_of(bitplanes.word_model(WORDS).encode(pa.array(texts))) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


SPECIAL = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "é", "It's", "\u0301"]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), SPECIAL), max_size=5))
def test_special_strings_are_the_librarys(texts):
    fresh = Tokenizer.from_file(WORDS)
    assert rows_of(bitplanes.word_model(WORDS).encode(pa.array(texts, pa.string()))) == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_offsets_cover_the_text(spark, nasty):
    for row in byte_bpe.encode(nasty.filter("length(text) < 1000").limit(8), RANKS, offsets=True).collect():
        assert len(row["ids"]) == len(row["starts"]) == len(row["ends"])
        assert all(a < b for a, b in zip(row["starts"], row["ends"]))
        assert row["starts"][:1] in ([], [0]) and list(row["starts"]) == sorted(row["starts"])
    one = spark.createDataFrame([(1, "né 😀.")], "doc_id long, text string")
    row = byte_bpe.encode(one, RANKS, offsets=True).first()
    text = "né 😀."
    assert row["ends"][-1] == len(text)
    bpe = byte_bpe.model(RANKS, public.PATTERN)
    for i, a, b in zip(row["ids"], row["starts"], row["ends"]):
        assert bpe.bytes_of[i] in text[a:b].encode()


def test_split_characters_and_unknown_ids(spark):
    bpe = byte_bpe.model(RANKS, public.PATTERN)
    ids = [bpe.tokenizer.token_to_id(c) for c in map(byte_bpe.byte_table().__getitem__, "é".encode())]
    assert list(bpe.decode_pieces(ids)) == ["", "é"]
    assert list(bpe.decode_pieces(ids[:1])) == ["�"]
    with pytest.raises(KeyError):
        bpe.decode([10**6])
    coded = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: (bytes(r["bytes"]), r["text"]) for r in byte_bpe.decode(coded, RANKS).collect()} == {
        1: ("é".encode(), "é"), 2: (b"\xc3", "�"), 3: (b"", ""), 4: (b"", "")}


def test_round_trip_of_nasty_rows(nasty, no_rows, reference):
    found = [r.asDict() for r in byte_bpe.round_trip(nasty, RANKS).collect()]
    expected = []
    for row in nasty.collect():
        ids = reference.encode_ordinary(row["text"] or "")
        expected.append({
            "doc_id": row["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256((row["text"] or "").encode()).hexdigest(), "same": True})
    same_rows(expected, found)
    assert byte_bpe.round_trip(no_rows, RANKS, with_ids=True).collect() == []


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize(("n", "width"), [(0, 2), (1, 2), (bitplanes.BLOCK_IDS, 2), (2 * bitplanes.BLOCK_IDS + 17, 4)])
def test_files_round_trip(n, width, bits):
    ids = np.random.default_rng(n).integers(0, 1 << (8 * width - 1), n).astype(f"<u{width}")
    content = bitplanes.pack(ids, width, bits)
    file = bitplanes.IdFile(content)
    assert len(file) == n and (file.read() == ids).all()
    for first, count in ((0, 1), (max(0, n - 5), 9), (n // 2, 70_000), (n, 3)):
        assert (file.read(first, count) == ids[first:first + count]).all()
    with pytest.raises(ValueError):
        bitplanes.IdFile(content[:-3])
    if n > 1:
        planes = bitplanes.to_planes(ids[:100], bits)
        assert (bitplanes.from_planes(planes, min(n, 100), width, bits) == ids[:100]).all()


def test_ids_that_do_not_fit_and_damage():
    with pytest.raises(ValueError):
        bitplanes.pack(np.array([70_000]), 2)
    content = bytearray(bitplanes.pack(np.zeros(1000, "<u2"), 2))
    file = bitplanes.IdFile(bytes(content))
    file.index[0] = (*file.index[0][:3], file.index[0][3] ^ 1, *file.index[0][4:])
    with pytest.raises(ValueError):
        file.read()


@pytest.mark.parametrize("file_ids", [bitplanes.FILE_IDS, 500])
def test_written_files_in_order(spark, nasty, no_rows, file_ids, monkeypatch):
    monkeypatch.setattr(bitplanes, "FILE_IDS", file_ids)
    folder = storage.folder(spark, "ids")
    bitplanes.write_ids(nasty, WORDS, 1, folder, parts=3, bits=file_ids == 500)
    found = [r.asDict() for r in bitplanes.read_ids(spark, folder).collect()]
    model, expected = bitplanes.word_model(WORDS), []
    for row in sorted(nasty.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = model.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        expected.append({"doc_id": row["doc_id"], "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [sum(r["n_tokens"] for r in by_start[:k]) for k in range(len(by_start))]
    assert [r["doc_id"] for r in by_start] == [r["doc_id"] for r in expected]
    same_rows(expected, [{k: v for k, v in r.items() if k != "start"} for r in found])
    folder = storage.folder(spark, "none")
    bitplanes.write_ids(no_rows, WORDS, 1, folder)
    assert bitplanes.read_ids(spark, folder).collect() == []
