"""Rule statistics against plain Python, and the forest's properties."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import isolation
from lacuna.llm.text import WordHasher


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\n", "中|", "\r", " a b a b a b a b a b\n", "\x85"]), max_size=40).map("".join)), max_size=6))
def test_counts(texts):
    found = isolation.counts(pa.array(texts, pa.string()), WordHasher())
    assert found.tolist() == [plain(t) for t in texts]


def test_nasty_rows(spark, nasty, no_rows):
    found = isolation.rule_statistics(nasty)
    rows = [r.asDict() for r in found.collect()]
    names = isolation.COUNTS
    expected = [dict(zip(["doc_id", *names], [r.doc_id, *plain(r.text)])) for r in nasty.select("doc_id", "text").collect()]
    same_rows([{k: r[k] for k in ["doc_id", *names]} for r in rows], expected)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)

    labels = spark.createDataFrame([(1, 1, "x"), (None, 0, "x"), (7, 0, "x"), (7, 1, "x"), (10, None, "x")], "doc_id long, quality int, score string")
    scored = isolation.scored(found, isolation.fit(found))
    judged = isolation.verdicts(scored, isolation.calibrate(scored, labels)).collect()
    assert len(judged) == nasty.count() and all(0 <= r["score"] <= 1 for r in judged)
    assert not any(r["kept"] and r["base_failed"] for r in judged)

    empty = isolation.rule_statistics(no_rows)
    scored = isolation.scored(empty, isolation.fit(empty))
    assert isolation.verdicts(scored, isolation.calibrate(scored, labels)).count() == 0
    assert isolation.calibrate(isolation.scored(found, isolation.fit(found)), labels.limit(0)) > 1


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    x[:40] += 9
    score = isolation.Forest([x[rng.choice(4000, 256, replace=False)] for _ in range(100)]).score(x)
    assert score[:40].min() > np.quantile(score[40:], 0.98)
    one = isolation.Forest([x[:2]])  # two rows: one split, path 1 for either
    assert np.allclose(one.score(x[:2]), 0.5)


def test_path_length_is_the_mean_over_trees():
    x = np.arange(8.0)[:, None]
    tree = isolation.Tree().grow(x, np.random.default_rng(0))
    reached = {}
    for value in x[:, 0]:
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + (value > tree.cut[node])
        reached.setdefault(node, []).append(value)
    assert sorted(v for own in reached.values() for v in own) == list(x[:, 0])
    forest = isolation.Forest([])
    forest.trees = [tuple(np.array(v) for v in (tree.feature, tree.cut, tree.left, tree.path))]
    forest.expected = [float(isolation.expected_path(8))]
    for node, own in reached.items():
        assert np.allclose(forest.score(np.array(own)[:, None]), 2 ** (-tree.path[node] / forest.expected[0]))


def test_calibration_holds_its_share(spark):
    good = [(i, 0.30 + i / 10_000, 1) for i in range(1000)]
    bad = [(5000 + i, 0.5 if i % 10 else 0.3, 0) for i in range(100)]
    found = spark.createDataFrame([(d, s, False) for d, s, _ in good + bad], "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad], "doc_id long, quality int")
    cut = isolation.calibrate(found, labels)
    kept = isolation.verdicts(found, cut).filter("kept").select("doc_id")
    assert kept.filter("doc_id < 5000").count() >= 990
    assert kept.filter("doc_id >= 5000").count() == 10


def test_held_out_junk_goes(spark, sf):
    """Calibrated on one half of the labels: the other half's junk goes, its good documents stay."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    found = isolation.rule_statistics(docs).cache()
    found = isolation.scored(found, isolation.fit(found)).cache()
    cut = isolation.calibrate(found, labels.filter("doc_id % 2 = 0"))
    rest = isolation.verdicts(found, cut).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    shares = {r["quality"]: r["kept"] for r in rest.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] >= 0.97 and shares[0] <= 0.1
