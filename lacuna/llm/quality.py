"""Quality scores by a regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics: logits of shares of bytes
and words, logarithms of lengths. Each class has a mean and a covariance that is shrunk
towards the pooled one and towards a multiple of the identity. A score is the logistic
of the difference of the two Gaussian log-densities plus the classes' log odds; the
Mahalanobis terms use the Cholesky factors computed once when fitting.

Fitting needs only counts, sums and products for each class, added up in tasks before
they are shuffled: all labelled rows take part, and the driver sees one matrix a class.

A null text counts as empty; every row gets a score. A document with several labels
counts once for each; null labels and null ids teach nothing. With one class or none the
score is the smoothed share of label 1. Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import SPACE, WordHasher, blocks, raw, words

FEATURES = (
    "length", "word_length", "line_words", "sentence_words", "distinct_words", "space", "lower", "upper", "digit", "beyond_ascii",
    "stops", "commas", "exclaims", "bars", "symbols", "shouted_words", "lines_repeated",
)
#: Weight of the pooled covariance in a class's own, and of the mean variance on the diagonal.
POOLED, IDENTITY = 0.5, 0.005

_CLASS = np.zeros(256, dtype=np.uint8)  # byte classes, in the order of the names below
_CLASS[SPACE] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".?:;"]] = 6
_CLASS[ord(",")] = 7
_CLASS[ord("!")] = 8
_CLASS[ord("|")] = 9
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 10


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive places ``first``."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[first[1:]] - upto[first[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row."""
    return np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=np.int64)


def statistics(texts: pa.Array, hasher: WordHasher) -> np.ndarray:
    """Transformed statistics of each text, rows by ``FEATURES``."""
    data, offsets = raw(texts)
    kinds = _CLASS[data]
    size = np.diff(offsets).astype(np.float64)
    count = [_sums(kinds == k, offsets) for k in range(11)]
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first).astype(np.float64)
    hashes = hasher(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum(kinds == 3)])
    shouted = (upper[ends] - upper[starts]) * 2 > ends - starts
    breaks = np.concatenate([np.flatnonzero(data == 10), offsets[1:]])
    line_ends = np.unique(breaks)
    line_starts = np.concatenate([[0], line_ends[:-1]])
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_hash = hasher(data, np.minimum(line_starts + (data[line_starts] == 10), line_ends), line_ends)
    line_first = np.searchsorted(line_starts, offsets)
    n_lines = np.diff(line_first).astype(np.float64)
    share = lambda k, of: np.log((k + 0.5) / (np.maximum(of - k, 0) + 0.5))
    ratio = lambda a, b: np.log((a + 1.0) / (b + 1.0))
    solid = size - count[1]
    return np.column_stack([
        np.log1p(size), ratio(solid, n_words), ratio(n_words, n_lines), ratio(n_words, count[6]), share(_distinct(hashes, first), n_words),
        share(count[1], size), *[share(count[k], solid) for k in (2, 3, 4, 5)],
        share(count[6], n_words), share(count[7], n_words), share(count[8], n_words), share(count[9], n_words), share(count[10], solid),
        share(_sums(shouted, first), n_words), share(n_lines - _distinct(line_hash, line_first), n_lines),
    ])


def document_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id, x`` (array of double) for every row."""

    def run(batches):
        hasher = WordHasher()
        for block in blocks(batches):
            x = statistics(block.column("text"), hasher)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), flat], ["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log-determinants, and the log odds of label 1."""

    odds: float
    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.odds)
        if self.means is not None:
            logs = []
            for mean, inverse, logdet in zip(self.means, self.inverses, self.logdets):
                away = (x - mean) @ inverse.T
                logs.append(-0.5 * (away * away).sum(axis=1) - 0.5 * logdet)
            z = z + logs[1] - logs[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


def moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and products of ``x`` for labels 0 and 1, over all rows of ``label, x``."""
    d = len(FEATURES)

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column("label").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total.ravel()[where])], ["place", "value"])

    rows = labelled.select("label", "x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(2 * (1 + d + d * d))
    total[rows["place"].to_numpy()] = rows["value"].to_numpy()
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d)


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Learn from the statistics of the documents that ``labels`` (``doc_id, quality``) marks 0 or 1."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    n, sums, products = moments(stats.join(known, "doc_id"))
    odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if n.min() < 2:
        return Discriminant(odds)
    means = sums / n[:, None]
    own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    whole = (own * n[:, None, None]).sum(axis=0) / n.sum()
    inverses, logdets = [], []
    for cov in own:
        cov = (1 - pooled) * cov + pooled * whole
        cov = (1 - identity) * cov + identity * (np.trace(whole) / len(whole) + 1e-6) * np.eye(len(whole))
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        inverses.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(odds, means, np.array(inverses), np.array(logdets))


def predict(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` for every row of ``doc_id, x``."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
