"""Grammar extensions and periodic runs against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import periodic, queries
from lacuna.llm.grammar import Grammar


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(24, 3 * q))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


repeating = st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 30)).map(lambda x: x[0] * x[1])
pieces = st.lists(st.one_of(repeating, st.text("abcd", max_size=12)), max_size=6).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_extensions_are_exact(texts):
    symbols = [0]
    for text in texts:
        symbols += [ord(c) for c in text] + [0]
    g = Grammar(np.array(symbols))
    places = np.flatnonzero(np.array(symbols) != 0)
    if len(places) < 2:
        return
    rng = np.random.default_rng(len(symbols))
    a, b = np.sort(rng.choice(places, (2, 60)), axis=0)
    a, b = a[a < b], b[a < b]
    forward, back = g.extend(a, b), g.extend_back(a, b)
    for x, y, f, r in zip(a, b, forward, back):
        k = 0
        while symbols[x + k] and symbols[x + k] == symbols[y + k]:
            k += 1
        assert f == k
        k = 0
        while symbols[x - k] and symbols[x - k] == symbols[y - k]:
            k += 1
        assert r == k


@settings(max_examples=200, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=5))
def test_runs(texts):
    offsets = np.cumsum([0] + [len(t) for t in texts])
    symbols = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    text, start, length, period = periodic.runs(symbols, offsets)
    for k, t in enumerate(texts):
        own = sorted(zip(*(x[text == k].tolist() for x in (start, length, period))))
        assert own == plain_runs(t)


def test_a_grammar_is_small_where_the_text_repeats():
    g = Grammar(np.array([0] + [1, 2, 3, 4, 5] * 20_000 + [0]))
    assert len(np.unique(g.name)) < 200
    assert g.extend(np.array([1]), np.array([6])).tolist() == [99_995]
    assert g.extend_back(np.array([99_995]), np.array([100_000])).tolist() == [99_995]


def nasty_texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "x " * 23, "x " * 24, "x\n\r\x0by " * 12, "x y z " * 400 + say(50), say(30_000)]
    texts += ["é a " * 30 + "　 \x85 " + "é a " * 30, (say(40) + " ") * 3, (say(40) + " ") * 2, " ".join((say(9) + " ") * 4 for _ in range(6)), "w" * 50_000]
    return texts


def test_every_case_through_spark(spark, nasty, no_rows):
    frame = spark.createDataFrame(list(enumerate(nasty_texts())), "doc_id long, text string").unionByName(nasty.select("doc_id", "text"))
    found = periodic.periodic_runs(frame).collect()
    texts = {}
    for row in frame.collect():
        texts.setdefault(row.doc_id, []).append(row.text)
    for row in found:
        split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[row.doc_id]]
        options = [(plain_runs(w), plain_collapsed(w, plain_runs(w))) for w in split if len(w) < 3000]
        if any(len(w) >= 3000 for w in split):
            continue
        assert ([tuple(r) for r in row.runs], row.collapsed) in options
    assert len(found) == frame.count()
    assert periodic.periodic_runs(no_rows).count() == 0


def test_the_query(spark, tmp_path, nasty):
    nasty.write.parquet(str(tmp_path / "documents.parquet"))
    more = spark.createDataFrame([(i, t, "x", "y", 1, "c", 1, "c", "c", 1) for i, t in enumerate(nasty_texts() * 9, 100)], nasty.schema)
    more.write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op12(spark, str(tmp_path)).collect()
    damaged = {}
    for row in queries.with_planted_repeats(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect():
        damaged.setdefault(row.doc_id, []).append(row.text)
    assert len(rows) == sum(map(len, damaged.values()))
    checked = 0
    for row in rows:
        options = []
        for text in damaged[row.doc_id]:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            if len(words) > 2000:
                options = None
                break
            own = plain_runs(words)
            best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            options.append((len(own), *best, 1000 * best[1] // best[2] if own else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(plain_collapsed(words, own))))
        if options:
            checked += 1
            assert tuple(row)[1:] in options
    assert checked > 100


def test_planted_repeats(spark):
    import zlib

    frame = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(100 + i))) for i in range(300)], "doc_id long, text string")
    for row in queries.with_planted_repeats(frame).collect():
        h, words = zlib.crc32(str(row.doc_id).encode()), [f"w{k}" for k in range(100 + row.doc_id)]
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert row.text == " ".join(words)


def test_words_are_told_apart_exactly():
    flat, symbols, offsets = periodic.split_words(pa.array(["a b a", None, "b\x0bc"]))
    assert flat == [b"a", b"b", b"a", b"b", b"c"] and offsets.tolist() == [0, 3, 3, 5]
    assert symbols[0] == symbols[2] and symbols[1] == symbols[3] and len(set(symbols.tolist())) == 3
