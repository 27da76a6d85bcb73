"""Language, quality, near-duplicates, lines, benchmark overlaps and shards against brute force."""

import re
import sys
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import same_rows, through_sql
from public_tokenizers import path
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, lang_id, line_templates, near_dup, quality, shards
from lacuna.llm.text import HASHED_BYTES, WordHasher, raw, words

PIECES = path("piece_bpe_32k.model")


# -- language ---------------------------------------------------------------------------

def segmentations(vocabulary, word):
    """All ways to cut a word, as lists of piece numbers."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        known = vocabulary.ids.get(word[:n])
        if known is None and n == 1:
            known = 0
        if known is not None:
            out += [[known, *rest] for rest in segmentations(vocabulary, word[n:])]
    return out


def test_forward_sums_every_segmentation():
    vocabulary = lang_id.pieces(PIECES)
    rng = np.random.default_rng(3)
    shares = rng.dirichlet(np.ones(vocabulary.size) * 0.1, 3).T
    names = ["▁the", "▁house", "▁ñandú", "▁中x", "▁a"]
    logs, _ = lang_id.forward(vocabulary.arcs(names), shares)
    counts = np.zeros_like(shares)
    for name, log in zip(names, logs):
        each = [(cut, np.prod(shares[cut], axis=0)) for cut in segmentations(vocabulary, name)]
        total = sum(p for _, p in each)
        np.testing.assert_allclose(np.exp(log), total, rtol=1e-9)
        for cut, p in each:
            for piece in cut:
                counts[piece] += p / total
    np.testing.assert_allclose(lang_id.expected(vocabulary.arcs(names), shares, np.ones((len(names), 3))), counts, rtol=1e-8, atol=1e-12)


def test_pieces_of_many_words_are_found_together():
    vocabulary = lang_id.pieces(PIECES)
    rng = np.random.default_rng(4)
    names = ["▁" + "".join(rng.choice(list("abcdefghilmnorstuéßñ中Ω𝒳▁"), n)) for n in rng.integers(0, 63, 800)] + ["", "▁the"]
    expected = []
    for w, name in enumerate(names):
        for i in range(len(name)):
            expected += [(j, w, i, k) for j in range(i + 1, len(name) + 1) if (k := vocabulary.ids.get(name[i:j], 0 if j == i + 1 else None)) is not None]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        *found, lengths = vocabulary.arcs(names)
    finally:
        sys.setprofile(None)
    word, begin, end, piece = (x.tolist() for x in found)
    assert list(zip(end, word, begin, piece)) == sorted(expected) and lengths.tolist() == [len(x) for x in names]
    assert len(calls) < lengths.sum() / 2  # no work of Python's for each letter
    assert all(len(x) == 0 for x in vocabulary.arcs([]))


def test_languages_are_told_and_learning_ignores_held_out(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = lang_id.fit(documents.filter(fold != 2), PIECES)
    assert model.languages == sorted(model.languages)
    found = lang_id.predict(documents, model, PIECES).join(documents, "doc_id").filter(fold == 2)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_language_of_nasty_rows(spark, nasty, no_rows):
    model = lang_id.fit(nasty, PIECES)
    assert model.languages == ["en", "fr"]
    found = lang_id.predict(nasty, model, PIECES).collect()
    rows = nasty.collect()
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in rows]
    for row, out in zip(rows, found):
        letter = any(c.isalpha() for c in row["text"] or "")
        assert (out["lang_pred"] in model.languages) == letter and (out["score"] > 0) == letter
    kept = lang_id.accepted(nasty, model, PIECES, 0.0)
    assert kept.columns == nasty.columns and kept.count() == sum(r["lang_pred"] != "und" for r in found)
    nothing = lang_id.fit(no_rows, PIECES)
    assert {r["lang_pred"] for r in lang_id.predict(nasty, nothing, PIECES).collect()} == {"und"}
    assert lang_id.predict(no_rows, model, PIECES).collect() == []


# -- quality ----------------------------------------------------------------------------

def test_quality_scores_are_gaussian_differences(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (200, d)), rng.normal(0.5, 2, (300, d))])
    y = np.repeat([0, 1], [200, 300])
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(stats, labels, 0.3, 0.01)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    whole = (own[0] * 200 + own[1] * 300) / 500
    logs = []
    for k in (0, 1):
        cov = 0.7 * own[k] + 0.3 * whole
        cov = 0.99 * cov + 0.01 * (np.trace(whole) / d + 1e-6) * np.eye(d)
        away = x - x[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    z = logs[1] - logs[0] + np.log(300.5 / 200.5)
    found = {r["doc_id"]: r["score"] for r in quality.predict(stats, model).collect()}
    np.testing.assert_allclose([found[i] for i in range(500)], 1 / (1 + np.exp(-z)), rtol=1e-6, atol=1e-9)


def test_quality_holds_out_of_fold(spark):
    sf = "/root/testdata/sf0.01"
    stats = quality.document_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = quality.predict(stats, quality.fit(stats.filter(fold != 1), labels)).join(labels, "doc_id").filter(fold == 1)
    assert found.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_of_nasty_rows(nasty, no_rows):
    stats = quality.document_statistics(nasty)
    labels = nasty.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scores = [r["score"] for r in quality.predict(stats, quality.fit(stats, labels)).collect()]
    assert len(scores) == nasty.count() and all(0 <= s <= 1 for s in scores)
    one = quality.fit(stats, labels.filter("quality = 1"))
    assert one.means is None and len({r["score"] for r in quality.predict(stats, one).collect()}) == 1
    empty = quality.document_statistics(no_rows)
    assert quality.predict(empty, quality.fit(empty, labels)).collect() == []


# -- near-duplicates --------------------------------------------------------------------

def shingles(text):
    found = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def groups_by_hand(rows):
    """doc_id to smallest linked doc_id, over all pairs of rows."""
    parent = {i: i for i, _ in rows if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        same = len(a & b)
        if a and b and 100 * same >= 75 * (len(a) + len(b) - same):
            low, high = sorted((top(i), top(j)))
            parent[high] = low
    return {i: top(i) for i in parent}


def mutated(rng, text, share):
    return " ".join(f"w{rng.integers(10**6)}" if rng.random() < share else w for w in text.split(" "))


def test_near_duplicates_are_all_found(spark):
    rng = np.random.default_rng(11)
    common = " ".join(f"c{rng.integers(10**6)}" for _ in range(60))
    rows = []
    for _ in range(40):
        base = " ".join(f"w{rng.integers(10**6)}" for _ in range(rng.integers(6, 120)))
        rows += [base] + [mutated(rng, base, s) for s in rng.uniform(0, 0.08, 6)]
    hot = " ".join(f"h{rng.integers(10**6)}" for _ in range(80))
    rows += [mutated(rng, hot, 0.02) for _ in range(60)] + [hot] * 20
    rows += [common + " " + " ".join(f"w{rng.integers(10**6)}" for _ in range(50)) for _ in range(50)]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k]) for i, k in enumerate(order)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == groups_by_hand(rows)
    assert all(r["n_shingles"] == len(shingles(rows[r["doc_id"]][1])) for r in found)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("large, sets", [(3, 5), (1, 512)])
def test_large_keys_in_blocks_lose_no_link(spark, monkeypatch, large, sets):
    monkeypatch.setattr(near_dup, "LARGE_KEY", large)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", sets)
    test_near_duplicates_are_all_found(spark)


def test_spanning_links_join_what_is_alike():
    rng = np.random.default_rng(2)
    for across in (False, True):
        sets = [np.unique(rng.integers(0, 60, rng.integers(8, 20))) for _ in range(8)]
        sets += [np.unique(np.append(np.delete(s, rng.integers(0, len(s))), rng.integers(0, 60))) for s in sets for _ in range(5)]
        n = len(sets)
        component, block = rng.integers(0, n - 5, n), rng.integers(0, 2, n)
        found = near_dup.spanning_links(np.arange(n), component, block, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), across)

        def joined(links, component=component):
            label = component.copy()
            for a, b in links:
                label[label == label[a]] = label[b]
            return {frozenset(np.flatnonzero(label == c).tolist()) for c in label}

        alike = [(a, b) for a, b in combinations(range(n), 2) if not (across and block[a] == block[b])
                 and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]
        assert set(map(frozenset, found)) <= set(map(frozenset, alike)) and len(found) < n
        assert joined(found) == joined(alike)


def test_near_duplicates_of_nasty_rows(nasty, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    found = [r.asDict() for r in near_dup.near_duplicates(nasty).collect()]
    group = groups_by_hand(rows)
    same_rows([{"doc_id": i, "n_shingles": len(shingles(t)), "component_id": group.get(i), "kept": group.get(i) == i} for i, t in rows], found)
    kept = near_dup.one_of_each_group(nasty)
    assert kept.columns == nasty.columns and kept.count() == sum(r["kept"] for r in found)
    assert near_dup.near_duplicates(no_rows).collect() == []


def test_pigeonhole_keys_miss_no_close_signature():
    """Any CHUNKS * (ERRORS + 1) - 1 differing symbols leave a chunk within its errors."""
    rng = np.random.default_rng(1)
    most = near_dup.CHUNKS * (near_dup.ERRORS + 1) - 1
    for _ in range(2000):
        differs = np.zeros(near_dup.SYMBOLS, bool)
        differs[rng.permutation(near_dup.SYMBOLS)[:most]] = True
        assert differs.reshape(near_dup.CHUNKS, near_dup.CHUNK).sum(axis=1).min() <= near_dup.ERRORS


@pytest.mark.parametrize("same, union", [(15, 20), (30, 40)])
def test_pairs_at_the_threshold_are_lost_as_rarely_as_stated(same, union):
    """Of pairs at a similarity of 0.75 six in a million share no key; dependent symbols lost one in some 500 small ones."""
    rng = np.random.default_rng(4)
    pairs, own = 20_000, (union - same) // 2
    x = rng.integers(0, 1 << 64, (pairs, union), dtype=np.uint64)
    sides = [x[:, :same + own], np.delete(x, np.arange(same, same + own), axis=1)]
    symbols = []
    for side in sides:
        packed = near_dup.signatures(np.sort(side, axis=1).reshape(-1), np.arange(pairs + 1) * side.shape[1])
        symbols.append(packed[:, :, None] >> near_dup._SHIFTS & np.uint64((1 << near_dup.LANE) - 1))
    differing = (symbols[0] != symbols[1]).sum(axis=2)
    lost = (differing.sum(axis=1) > near_dup.MOST_DIFFERENT) | (differing.min(axis=1) > near_dup.ERRORS)
    assert lost.sum() <= 2
    assert abs(differing.sum(axis=1).mean() - near_dup.SYMBOLS / 4) < 0.1


def test_signatures_do_not_depend_on_the_stretch(monkeypatch):
    rng = np.random.default_rng(5)
    offsets = np.cumsum([0, 3, 0, 40, 1, 0, 200, 7])
    sets = rng.integers(0, 1 << 64, offsets[-1], dtype=np.uint64)
    whole = near_dup.signatures(sets, offsets)
    monkeypatch.setattr(near_dup, "_STRETCH", 10)
    assert len(whole) == 5 and (near_dup.signatures(sets, offsets) == whole).all()


def test_word_hashes_do_not_depend_on_the_stretch():
    texts = pa.array(["alpha beta  gamma", None, "", "beta", "x" * (HASHED_BYTES + 5) + " beta"])
    data, offsets = raw(texts)
    starts, ends, first = words(data, offsets)
    assert first.tolist() == [0, 3, 3, 3, 4, 6]
    hashes = WordHasher()(data, starts, ends)
    assert hashes[1] == hashes[3] == hashes[5] and len(set(hashes.tolist())) == 4


# -- lines ------------------------------------------------------------------------------

def test_lines_as_in_sql(nasty, no_rows):
    for frame in (nasty, no_rows):
        documents = frame.select("doc_id", "text")
        found = [r.asDict() for r in line_templates.clean(documents).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        same_rows(through_sql(line_templates.SQL, documents=documents), found)
    assert line_templates.clean(nasty).columns == [c for c in nasty.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


def test_templates_generalise_fields_and_leave_prose(spark):
    log = "connection closed from the host {} after a timeout of user {}"
    rows = [(1, log.format("alpha", "ann") + "\nkeep this very line alone"), (2, log.format("beta", "bob") + "\nanother line of its own"),
            (3, log.format("gamma", "cy")), (4, "connection closed from the other side of that town as far as anyone knows"), (5, "a b\na b"), (6, "a b"), (7, "line 12 of 30 here\nline 12 of 30 here"), (8, "line 7 of 9 here")]
    found = {r["doc_id"]: r["text"] for r in line_templates.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: rows[0][1], 2: "another line of its own", 3: "", 4: rows[3][1], 5: "a b\na b", 6: "a b", 7: rows[6][1], 8: ""}
    often = {r["doc_id"]: r["text"] for r in line_templates.clean(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert often[3] == "" and often[8] == rows[7][1]


# -- benchmark --------------------------------------------------------------------------

def test_masks_find_every_allowed_window():
    for hit in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(at + m not in hit for m in mask) for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - mask[-1]))


def test_overlaps_as_in_sql(spark, nasty, no_rows):
    rng = np.random.default_rng(2)
    item = [f"t{k}" for k in range(20)]
    rows = []
    for changed in (0, 1, 2, 3, 5):
        for at in (0, 4):
            own = list(item)
            for k in rng.permutation(13)[:changed]:
                own[at + k if at + k < 20 else k] = "zz"
            rows += [" ".join(["x", "y"][:at] + own + ["end"]), " ".join(own[:13]), " ".join(own[:12]), " ".join(own[8:])]
    rows += ["six seven eight nine ten", "five six seven EIGHT nine, ten eleven", "one two three"]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").union(nasty.select("doc_id", "text"))
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, "Six seven eight nine ten"), (3, "one two three"), (4, None), (None, "five six seven eight nine"), (6, "the of " * 20), (7, "")], "item_id long, text string")
    found = [r.asDict() for r in decontaminate.contamination(documents, benchmark).collect()]
    same_rows(through_sql(decontaminate.SQL, documents=documents, benchmark=benchmark), found)
    assert sum(r["contaminated"] for r in found) > 10
    clean = decontaminate.uncontaminated(nasty, benchmark)
    assert clean.columns == nasty.columns
    assert not any(r["contaminated"] for r in decontaminate.contamination(nasty, benchmark.limit(0)).collect())
    assert decontaminate.contamination(no_rows, benchmark).collect() == []


# -- shards -----------------------------------------------------------------------------

@pytest.mark.parametrize("ranges", [(192, 4096), (5, 5)])
def test_shards_have_near_equal_bytes(nasty, no_rows, spark, sf, ranges, monkeypatch):
    monkeypatch.setattr(shards, "MIN_RANGES", ranges[0])
    monkeypatch.setattr(shards, "MAX_RANGES", ranges[1])
    hot = spark.range(400).select((F.col("id") % 3 + 10**6).alias("doc_id"), F.lit("the same text").alias("text"))
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(nasty.select("doc_id", "text").filter("length(text) < 20000 or text is null")).union(hot)
    rows = [r.asDict() for r in shards.shard_by_bytes(documents, 7).collect()]
    same_rows([{"doc_id": r["doc_id"], "size": len((r["text"] or "").encode()) + 8, "text_crc32": zlib.crc32((r["text"] or "").encode())} for r in documents.collect()],
              [{k: r[k] for k in ("doc_id", "size", "text_crc32")} for r in rows])
    held = {s: [r for r in rows if r["shard"] == s] for s in range(7)}
    assert sum(map(len, held.values())) == len(rows)
    sizes = [sum(r["size"] for r in own) for own in held.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in held.values())
    assert shards.shard_by_bytes(no_rows, 7).collect() == []


def test_range_search(spark):
    for n in (0, 1, 2, 5, 40):
        cuts = [f"{k:03d}" for k in range(0, 2 * n, 2)]
        keys = spark.createDataFrame([(f"{k:03d}",) for k in range(2 * n + 1)], "key string")
        assert all(r["n"] == sum(c <= r["key"] for c in cuts) for r in keys.select("key", shards.range_of(F.col("key"), cuts).alias("n")).collect())




def test_first_shared_key_and_differences_of_signatures(spark):
    rng = np.random.default_rng(9)
    left = rng.integers(0, 1 << 11, (200, near_dup.SYMBOLS)).astype(np.uint64)
    right = np.where(rng.random(left.shape) < rng.random((200, 1)) * 0.6, rng.integers(0, 1 << 11, left.shape), left).astype(np.uint64)
    pack = lambda x: (x.reshape(near_dup.CHUNKS, near_dup.CHUNK) << near_dup._SHIFTS).sum(axis=1).astype(np.int64).tolist()
    names = [f"{side}{k}" for side in "xy" for k in range(near_dup.CHUNKS)]
    frame = spark.createDataFrame([(i, *pack(a), *pack(b)) for i, (a, b) in enumerate(zip(left, right))], "i int, " + ", ".join(f"{n} long" for n in names))
    frame = frame.select("i", *[F.struct(*[F.col(f"{side}{k}").alias(f"s{k}") for k in range(near_dup.CHUNKS)]).alias(side) for side in "xy"])
    every = F.explode(F.sequence(F.lit(0), F.lit(near_dup.CHUNKS * len(near_dup.KEPT) - 1))).alias("at")
    rows = frame.select("i", "x", "y", every).select("i", "at", near_dup.differing("x", "y").alias("n"), near_dup.first_shared("x", "y", "at").alias("first")).collect()
    for r in rows:
        same = (left[r["i"]] == right[r["i"]]).reshape(near_dup.CHUNKS, near_dup.CHUNK)
        keys = [c * len(near_dup.KEPT) + k for c in range(near_dup.CHUNKS) for k, places in enumerate(near_dup.KEPT) if all(same[c][p] for p in places)]
        assert r["n"] == (left[r["i"]] != right[r["i"]]).sum()
        if r["at"] in keys:
            assert r["first"] == (r["at"] == keys[0])


def test_groups_and_shards_as_in_sql(nasty, no_rows):
    for frame in (nasty, no_rows):
        documents = frame.select("doc_id", "text").filter("text is null or length(text) < 20000")
        same_rows(through_sql(near_dup.SQL, documents=documents), [r.asDict() for r in near_dup.near_duplicates(documents).collect()])
        found = shards.shard_by_bytes(documents, 24).select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))
        drop = lambda rows: [{k: v for k, v in r.items() if k != "slot"} for r in rows]  # noqa: E731  equal rows may change places
        same_rows(drop(through_sql(shards.SQL, documents=documents)), drop(r.asDict() for r in found.collect()))
