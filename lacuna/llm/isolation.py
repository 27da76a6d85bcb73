"""Quality rules with an isolation forest on rule statistics.

Every whole text gives five counts and a base verdict. The counts become ``FEATURES``,
and a forest of ``TREES`` random trees, each over ``SAMPLE`` documents, measures how many
random splits it takes to isolate a document: anomalous ones need few. The score is
``2 ** (-path / expected)``, between 0 and 1. The threshold is set with all labelled
rows: the cut that tells labels 0 and 1 apart best among those that reject at most
``MAX_REJECTED`` of the rows labelled 1.

What is bounded: each tree sees ``SAMPLE`` documents by its method, drawn by a hash from
those that pass the base rules (``TREES * SAMPLE`` rows of three numbers reach the driver). Calibration and
scoring take every row; calibration shuffles counts for ``BINS`` scores a label.

A null text counts as empty and fails the base rules; every row gets a verdict. A null
doc_id or label calibrates nothing, a document with several labels counts once for each,
repeated rows are scored alike. Without documents, or with no label 1 or no label 0, the
method rejects nothing. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import SPACE, WordHasher, blocks, mix, raw, words

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; per cent of them
TREES, SAMPLE, BINS, MAX_REJECTED = 100, 256, 2000, 0.01
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Repetition is left to the base rules: good documents with a few repeats are rarer than junk, so a forest over
#: these too isolates them first (with the same share of good rows rejected, 23 % of the bad ones go instead of 98 %).
FEATURES = ["log_words", "word_length", "symbols"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PLACES = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``bounds``."""
    upto = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=upto[1:])
    return np.diff(upto[bounds])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs more than once, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    often, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    often[order[1:]] = later[order[1:]] = same
    often[order[:-1]] |= same
    return often, later


def counts(texts: pa.Array, hasher: WordHasher) -> np.ndarray:
    """The five counts of each text, rows by ``COUNTS``; words, lines and windows are compared by 64-bit hashes."""
    data, offsets = raw(texts)
    rows = np.arange(len(texts))
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    char = ~SPACE[data] & ((data & 0xC0) != 0x80)

    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:] |= data == 10
    edge[len(data)] = False
    begins = np.flatnonzero(edge)
    stops = np.append(begins[1:], len(data)) if len(begins) else begins
    stops = stops - (data[np.maximum(stops, 1) - 1] == 10) if len(begins) else stops
    filled = np.diff(np.searchsorted(starts, np.append(begins, len(data)))) > 0
    begins, stops = begins[filled], stops[filled]
    owner = np.searchsorted(offsets, begins, side="right") - 1
    _, later = _repeats(mix(hasher(data, begins, stops) ^ mix(owner.astype(np.uint64))))
    dup_lines = np.bincount(owner[later], minlength=len(rows))

    hashes = hasher(data, starts, ends)
    whole = np.maximum(n - WINDOW + 1, 0)
    place = np.arange(whole.sum()) + np.repeat(first[:-1] - (np.cumsum(whole) - whole), whole)
    windows = np.repeat(mix(rows.astype(np.uint64)), whole)
    for k in range(WINDOW):
        windows += hashes[place + k] * _PLACES[k]
    often, _ = _repeats(mix(windows))
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, place[often], 1)
    np.add.at(cover, place[often] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return np.column_stack([n, _per_row(char, offsets), _per_row(_SYMBOL[data], offsets), dup_lines, _per_row(repeated, first)])


def rule_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts as longs and ``base_failed`` for every row."""

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches):
            found = counts(block.column("text"), hasher)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(c) for c in found.T]], ["doc_id", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS])
    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def features(stats: DataFrame) -> DataFrame:
    """``stats`` with the inputs of the forest."""
    n = F.greatest("n_words", F.lit(1))
    values = [F.log1p("n_words"), F.col("word_chars") / n, F.col("n_symbols") / n]
    return stats.withColumns(dict(zip(FEATURES, values)))


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search in a random binary tree of ``n`` leaves, which stands for what a leaf leaves unsplit."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes as arrays: the feature of a split (-1: leaf), its cut, the left child (right: the next), the path at a leaf."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    path: list = field(default_factory=list)

    def add(self) -> int:
        for values, start in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.path, 0.0)):
            values.append(start)
        return len(self.left) - 1

    def grow(self, x: np.ndarray, rng: np.random.Generator) -> Tree:
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        todo = [(self.add(), x, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or not len(open_):
                self.path[node] = depth + float(expected_path(len(own)))
                continue
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            self.feature[node], self.cut[node], self.left[node] = f, cut, self.add()
            self.add()
            right = own[:, f] > cut
            todo += [(self.left[node] + 1, own[right], depth + 1), (self.left[node], own[~right], depth + 1)]
        return self


class Forest:
    """Trees over samples of rows; ``score`` is near 1 for rows that few splits isolate."""

    def __init__(self, samples: list[np.ndarray], seed: int = 7):
        rng = np.random.default_rng(seed)
        grown = [Tree().grow(x, rng) for x in samples if len(x)]
        self.trees = [tuple(np.array(v) for v in (t.feature, t.cut, t.left, t.path)) for t in grown]
        self.expected = [max(float(expected_path(len(x))), 1e-9) for x in samples if len(x)]

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for (feature, cut, left, path), expected in zip(self.trees, self.expected):
            node = np.zeros(len(x), dtype=np.int64)
            live = np.flatnonzero(feature[node] >= 0)
            while len(live):
                at = node[live]
                node[live] = left[at] + (x[live, feature[at]] > cut[at])
                live = live[feature[node[live]] >= 0]
            depth += path[node] / expected
        return 2.0 ** (-depth / max(len(self.trees), 1)) if self.trees else np.zeros(len(x))


def fit(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest over hash-drawn documents of ``stats`` (with its features) that pass the base rules.

    The rows with the least hashes are dealt to the trees in turn; of few rows each tree draws its own half.
    """
    draw = F.xxhash64("doc_id", *COUNTS, F.lit(11))
    rows = features(stats).filter(~F.col("base_failed")).select(draw.alias("draw"), *FEATURES).orderBy("draw", *FEATURES).limit(trees * sample).toArrow()
    x = np.column_stack([rows[c].to_numpy() for c in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    if len(x) >= trees * sample:
        return Forest([x[k::trees] for k in range(trees)])
    rng = np.random.default_rng(3)
    return Forest([x[rng.permutation(len(x))[:min(sample, (len(x) + 1) // 2)]] for _ in range(trees)])


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the anomaly ``score``."""
    names = stats.columns

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(forest.score(x))], [*names, "score"])

    return features(stats).mapInArrow(run, stats.schema.simpleString()[7:-1].replace(":", " ") + ", score double")


def calibrate(found: DataFrame, labels: DataFrame, max_rejected: float = MAX_REJECTED) -> float:
    """The score from which documents are rejected, by all rows of ``found`` that ``labels`` (``doc_id, quality``) marks."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    bins = found.filter(~F.col("base_failed")).select("doc_id", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
    table = bins.join(known, "doc_id").groupBy("label", "bin").count().toArrow().to_pylist()
    held = np.zeros((2, BINS + 2))
    for row in table:
        held[row["label"], row["bin"]] += row["count"]
    if held.sum(axis=1).min() == 0:
        return 2.0
    rejected = held[:, ::-1].cumsum(axis=1)[:, ::-1] / held.sum(axis=1, keepdims=True)  # at each cut, the shares at or above
    gain = np.where(rejected[1] <= max_rejected, rejected[0] - rejected[1], 0.0)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal cuts the highest
    return best / BINS if gain[best] > 0 else 2.0


def verdicts(found: DataFrame, threshold: float) -> DataFrame:
    """``found`` with ``kept``: the base rules hold and the score stays below ``threshold``."""
    return found.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") * BINS) < F.lit(round(threshold * BINS))))
