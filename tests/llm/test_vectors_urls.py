"""Nearest neighbours and URL lists against brute force, and the pipeline's stages."""

import datetime as dt
import random

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import decontaminate, hash_forest, near_dup, url_filter


def by_hand(vectors, k):
    """Exact neighbours of every vector whose id divides by 20."""
    out = {}
    for i, x in vectors.items():
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vectors.items() if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, rng.uniform(0.5, 3), 6).astype(np.float32).astype(float).tolist() for i in range(150)}
    for i in range(40, 75):
        vectors[i] = vectors[40]  # ties
    rows = [(i, x, "clash", 1) for i, x in vectors.items()]
    rows += [(200, None, "c", 1), (220, [0.0] * 6, "c", 1), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c", 1), (260, [float("nan")] * 6, "c", 1), (280, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], "c", 1), (300, [1.0], "c", 1), (None, [1.0] * 6, "c", 1), (20, vectors[20], "c", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string, rank int")
    found, expected = found_of(hash_forest.search(frame, "vec_id % 20 = 0", 20)), by_hand(vectors, 20)
    assert {i: [j for j, _ in v] for i, v in found.items()} == {i: [j for j, _ in v] for i, v in expected.items()}
    for i, own in found.items():
        np.testing.assert_allclose([s for _, s in own], [s for _, s in expected[i]], rtol=1e-12)
    assert hash_forest.search(frame.limit(0), "vec_id % 20 = 0", 20).collect() == []
    few = found_of(hash_forest.search(frame.filter("vec_id in (0, 1, 2)"), "vec_id % 20 = 0", 20))
    assert {i: len(v) for i, v in few.items()} == {0: 2}


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_the_forest(spark, clustered, monkeypatch):
    monkeypatch.setattr(hash_forest, "CELL", 200)
    monkeypatch.setattr(hash_forest, "CHUNK", 150)
    monkeypatch.setattr(hash_forest, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    if clustered:
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.15 * x
        x[500:1500] = x[500] + 1e-3 * rng.normal(size=(1000, 16))  # a third of the rows almost alike
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = found_of(hash_forest.search(frame, "vec_id % 20 = 0", 20))
    score = x[::20] @ x.T
    score[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    nearest = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len({j for j, _ in found[20 * i]} & set(own.tolist())) / 20 for i, own in enumerate(nearest)]) >= 0.9
    assert all(len(v) == 20 for v in found.values())


# -- URLs -------------------------------------------------------------------------------

def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_entries_hold_from_their_addition_to_their_removal(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "example.com", "Shop.example.org", "ample.com"]
    kinds = {"host": hosts, "domain": ["example.com", "com", "example.org", "A.Example.com"], "prefix": ["a.example.com/", "a.example.com/x", "b.example.com/x/y/", "shop.example.org/X"]}
    events = [(rng.choice(["l1", "l2", "ok"]), kind, rng.choice(kinds[kind]), rng.choice(["add", "add", "remove"]), day(rng.choice([0, 3, 9, 40, 70, 200, 400]))) for kind in kinds for _ in range(25)]
    events = [(name, "allow" if name == "ok" else "block", *rest) for name, *rest in events] + [(None, "block", "host", hosts[0], "add", day(0)), ("l1", "block", "host", hosts[0], "add", None), ("l1", "block", "host", None, "add", day(1))]
    captures = [(k, rng.choice(["http", "HTTPS"]) + "://" + rng.choice(["", "me@"]) + rng.choice(hosts) + rng.choice(["", ":80"]) + rng.choice(["", "/", "/x", "/x/y/z", "/X?q=/x", "/xy", "//x"]), day(rng.randrange(-5, 450)), "clash") for k in range(300)]
    captures += [(1, None, day(3), ""), (None, "http://a.example.com/", day(5), ""), (2, "no url", day(5), ""), (3, "http://a.example.com/", None, ""), captures[5], (4, "http://a.example.com/" + "x/" * 3000, day(10), "")]

    def active(name, kind, pattern, at):
        state = 0
        for moment, act in sorted({(e[5], e[4] != "add") for e in events if None not in e and (e[0], e[2], norm(e[2], e[3])) == (name, kind, pattern)}):
            if moment <= at:
                state = not act
        return state

    def norm(kind, pattern):
        if kind != "prefix":
            return pattern.lower()
        host, _, rest = pattern.partition("/")
        return host.lower() + "/" + "/".join(p for p in rest.split("/") if p)

    keys = {(e[0], e[1], e[2], norm(e[2], e[3])) for e in events if None not in e}
    expected = []
    for i, url, at, _ in captures:
        met = []
        if url and "://" in url and at:
            rest = url.split("://", 1)[1]
            site, _, way = rest.partition("/")
            host = site.split("@")[-1].split(":")[0].split("?")[0].lower()
            parts = [p for p in way.split("?")[0].split("/") if p]
            for name, verdict, kind, pattern in keys:
                if kind == "prefix":
                    own, _, tail = pattern.partition("/")
                    want = [p for p in tail.split("/") if p]
                    hit = own == host and parts[:len(want)] == want
                else:
                    hit = host == pattern or kind == "domain" and host.endswith("." + pattern)
                if hit and active(name, kind, pattern, at):
                    met.append((name, verdict))
        verdicts = {v for _, v in met}
        expected.append({"capture_id": i, "blocked": verdicts == {"block"}, "n_entries": len(met), "lists": ",".join(sorted({n for n, _ in met}))})
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched timestamp, period string")
    listed = spark.createDataFrame(events, "list string, verdict string, kind string, pattern string, action string, at timestamp")
    same_rows(expected, [r.asDict() for r in url_filter.url_filter(frame, listed).collect()])
    assert sum(r["n_entries"] > 0 for r in expected) > 50
    assert not any(r["n_entries"] for r in url_filter.url_filter(frame, listed.limit(0)).collect())
    assert url_filter.url_filter(frame.limit(0), listed).collect() == []


# -- pipeline ---------------------------------------------------------------------------

def test_stages_of_the_pipeline(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "!!! 123", "en", "s", 7), (10**6 + 1, None, None, None, None)], documents.schema)
    docs, seen = documents.union(extra), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) <= set(before)
        if name != "byte_bpe":
            assert out.columns == documents.columns
        if name == "language":
            assert set(before) - set(rows) == {10**6, 10**6 + 1}
        elif name == "line_dedup":
            lines = [(x, i) for i, r in rows.items() for x in set((r["text"] or "").split("\n")) if len(x.split()) >= 3]
            assert len(lines) == len({x for x, _ in lines})
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        elif name == "near_dedup":
            kept = near_dup.near_duplicates(docs).filter("kept").collect()
            assert set(rows) == {r["doc_id"] for r in kept}
        elif name == "decontamination":
            bad = decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()
            assert set(before) - set(rows) == {r["doc_id"] for r in bad}
        else:
            assert all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in rows.values()) and set(rows) == set(before)
        seen.append(len(rows))
        docs = out
    assert corpus_pipeline.run(spark, sf).select(F.count(F.lit(1))).first()[0] >= seen[-1] - 2
