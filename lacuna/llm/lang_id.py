"""Language identification by unigrams whose segmentations are summed out.

The pieces are those of a fixed public vocabulary. A language is a probability for each
piece; a word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities (the forward algorithm), and a text's is the product over
its words. Words are lower-cased runs of letters behind the vocabulary's word mark; as no
piece crosses words, each distinct word of a block is scored once.

Probabilities are learned by expectation maximisation from word counts of a bounded
sample of labelled texts: expected piece counts come from forward and backward sums.
Letters outside the vocabulary count as one piece, shared by all of them.

Score: the posterior of the best language under the learned shares of the languages.
A null text, or one without letters, is ``und`` with score 0. Ties go to the first
language in alphabetical order. Rows stay as they are, repeated rows included; with
nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import FORGET, blocks

UND = "und"
#: A classifier may be fitted on a bounded sample: so many labelled texts of each language at most, in expectation.
SAMPLE_TEXTS = 1500
MAX_LANGUAGES = 256
ROUNDS = 3
#: Added to every piece's expected count, so that no language excludes a piece.
PRIOR = 0.1
#: A word beyond this length is scored in stretches of it, which bounds a word's table.
STRETCH = 64
#: Each piece probability is multiplied by this for each of its letters while words are summed, against underflow.
SCALE = 8.0
MARK = "▁"


class Pieces:
    """The pieces of a sentencepiece vocabulary that consist of lower-case letters, with or without the word mark."""

    def __init__(self, path: str):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (reader.id_to_piece(i) for i in range(reader.get_piece_size()))
        kept = sorted({t for t in texts if t == MARK or ((bare := t.removeprefix(MARK)).isalpha() and bare == bare.lower())})
        self.ids = {text: k + 1 for k, text in enumerate(kept)}  # 0: a letter that no piece covers
        self.ids.setdefault(MARK, len(self.ids) + 1)
        self.size = len(self.ids) + 1
        # The trie of the pieces: a step from a node by a letter is a key of a sorted table, node 0 is its root.
        letters = sorted({ord(c) for text in self.ids for c in text})
        place = {c: k for k, c in enumerate(letters)}
        self.letters, self.width = np.array(letters, dtype=np.uint32), len(letters)
        nodes: dict[int, int] = {}
        found = {0: -1}
        for text, k in self.ids.items():
            at = 0
            for c in text:
                at = nodes.setdefault(at * self.width + place[ord(c)], len(nodes) + 1)
            found[at] = k
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.steps, self.targets = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.piece = np.array([found.get(node, -1) for node in range(len(nodes) + 1)], dtype=np.int32)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The nodes that steps lead to, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.steps, keys), len(self.steps) - 1)
        return np.where(self.steps[at] == keys, self.targets[at], -1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece that fits in a word: word, begin, end and piece, by end, word and begin; and the words' lengths."""
        lengths = np.array([len(t) for t in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        letter = np.minimum(np.searchsorted(self.letters, codes), self.width - 1)
        letter = np.where(self.letters[letter] == codes, letter, -1)
        of = np.repeat(np.arange(len(words)), lengths)
        begin = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - begin  # letters from here to the word's end
        alone = np.ones(len(codes), dtype=bool)  # no piece of just this letter
        starts, sizes, numbers = [], [], []
        places, node, size = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        while len(places):  # all pieces grow by a letter at a time
            next_letter = letter[places + size]
            node = np.where(next_letter >= 0, self._step(node * self.width + np.maximum(next_letter, 0)), -1)
            places, node, size = places[node >= 0], node[node >= 0], size + 1
            whole = self.piece[node] >= 0
            starts.append(places[whole])
            sizes.append(np.full(len(starts[-1]), size))
            numbers.append(self.piece[node[whole]])
            if size == 1:
                alone[starts[0]] = False
            longer = left[places] > size
            places, node = places[longer], node[longer]
        starts.append(np.flatnonzero(alone))
        sizes.append(np.ones(len(starts[-1]), dtype=np.int64))
        numbers.append(np.zeros(len(starts[-1]), dtype=np.int32))
        start, piece = np.concatenate(starts), np.concatenate(numbers)
        word, first = of[start], begin[start]
        end = first + np.concatenate(sizes)
        stretch = int(lengths.max(initial=0)) + 1
        order = np.argsort((end * len(words) + word) * stretch + first)
        return *(x[order].astype(np.int32) for x in (word, first, end, piece)), lengths


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def forward(arcs, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its log-probability in each language, and the table of scaled forward sums.

    ``shares``: pieces by languages.
    """
    word, begin, end, piece, lengths = arcs
    sums = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, shares.shape[1]))
    sums[:, 0] = 1.0
    weights = shares[piece] * (SCALE ** (end - begin))[:, None]
    edges = np.searchsorted(end, np.arange(1, sums.shape[1] + 1))
    for at in range(1, sums.shape[1]):
        own = slice(edges[at - 1], edges[at])
        heads = _runs(word[own])
        if len(heads):
            sums[word[own][heads], at] = np.add.reduceat(sums[word[own], begin[own]] * weights[own], heads, axis=0)
    last = sums[np.arange(len(lengths)), lengths]
    return np.log(np.maximum(last, 1e-300)) - (lengths * np.log(SCALE))[:, None], sums


def expected(arcs, shares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected count of each piece (by language) in words that occur ``counts`` times (words by languages)."""
    word, begin, end, piece, lengths = arcs
    _, sums = forward(arcs, shares)
    back = np.zeros_like(sums)
    total = sums[np.arange(len(lengths)), lengths]
    back[np.arange(len(lengths)), lengths] = counts / np.maximum(total, 1e-300)
    weights = shares[piece] * (SCALE ** (end - begin))[:, None]
    order = np.lexsort((word, -begin))
    out = np.zeros_like(shares)
    edges = np.searchsorted(-begin[order], -np.arange(sums.shape[1] - 1, -1, -1), side="left")
    edges = np.append(edges, len(order))
    for step in range(sums.shape[1]):  # from the last place to the first
        own = order[edges[step]:edges[step + 1]]
        if len(own):
            flow = back[word[own], end[own]] * weights[own]
            heads = _runs(word[own])
            back[word[own][heads], begin[own][0]] += np.add.reduceat(flow, heads, axis=0)
            np.add.at(out, piece[own], flow * sums[word[own], begin[own]])
    return out


def letter_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters of all rows, as indices into the distinct ones, and the ``n + 1`` row offsets."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), r"[^\p{L}]+")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)).dictionary_encode(), before[offsets]


def stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words with their mark, cut where they are over-long; and for each part the word it is of."""
    parts, of = [], []
    for k, word in enumerate(words):
        word = MARK + word
        for i in range(0, len(word), STRETCH):
            parts.append(word[i:i + STRETCH])
            of.append(k)
    return parts, np.array(of, dtype=np.int64)


@dataclass
class Model:
    """Languages, log shares of the languages, and piece probabilities (pieces by languages)."""

    languages: list[str]
    prior: np.ndarray
    shares: np.ndarray

    def words(self, vocabulary: Pieces, distinct: list[str], step: int = 4_000) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(distinct), len(self.languages)))
        for first in range(0, len(distinct), step):
            parts, of = stretches(distinct[first:first + step])
            logs, _ = forward(vocabulary.arcs(parts), self.shares)
            np.add.at(out[first:first + step], of, logs)
        return out


class Scorer:
    """Scores texts; keeps the scores of words seen before while there is room."""

    def __init__(self, vocabulary: Pieces, model: Model, room: int = 200_000):
        self.vocabulary, self.model, self.room = vocabulary, model, room
        self.seen: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Predicted language and score of each text."""
        n, model = len(texts), self.model
        coded, rows = letter_words(texts)
        if not model.languages or not rows[-1]:
            return [UND] * n, np.zeros(n)
        distinct = coded.dictionary.to_pylist()
        if len(self.seen) + len(distinct) > self.room:
            self.seen, self.logs = {}, self.logs[:0]
        new = [w for w in distinct if w not in self.seen]
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
        self.logs = np.concatenate([self.logs, model.words(self.vocabulary, new)])
        logs = self.logs[np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct))]
        some = rows[1:] > rows[:-1]
        sums = np.zeros((n, len(model.languages)))
        sums[some] = np.add.reduceat(logs[coded.indices.to_numpy()], rows[:-1][some], axis=0)
        sums += model.prior
        best = sums.argmax(axis=1)
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = np.where(some, 1.0 / share.sum(axis=1), 0.0)
        return [model.languages[b] if s else UND for b, s in zip(best, some)], score


def word_counts(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """``word, counts`` (a count for each language) over texts with a known ``lang``.

    Each task sends a row for each distinct word and language of a block, so a frequent
    word or language is summed before the shuffle.
    """

    def run(batches):
        place = {name: k for k, name in enumerate(languages)}
        for block in blocks(batches):
            coded, rows = letter_words(block.column("text"))
            of = np.repeat(np.array([place[x] for x in block.column("lang").to_pylist()], dtype=np.int64), np.diff(rows))
            pairs, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(languages) + of, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(pairs // len(languages))).cast(pa.string()), pa.array((pairs % len(languages)).astype(np.int32)), pa.array(n, pa.int64())],
                ["word", "of", "n"])

    rows = labelled.select("text", "lang").mapInArrow(run, "word string, of int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("of") == k, F.col("n"))), F.lit(0)) for k in range(len(languages))]
    return rows.groupBy("word").agg(F.array(*sums).alias("counts"))


def expected_counts(words: DataFrame, path: str, shares: np.ndarray) -> np.ndarray:
    """Expected piece counts over a word table; what reaches the driver is bounded by pieces times languages."""
    broad = words.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary, total = pieces(path), np.zeros_like(broad.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 4_000):
                some = batch.slice(first, 4_000)
                parts, of = stretches(some.column("word").to_pylist())
                counts = some.column("counts").flatten().to_numpy().reshape(-1, total.shape[1]).astype(np.float64)
                total += expected(vocabulary.arcs(parts), broad.value, counts[of])
        piece, of = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(total[piece, of])], ["piece", "of", "n"])

    rows = words.mapInArrow(run, "piece int, of int, n double").groupBy("piece", "of").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros_like(shares)
    out[rows["piece"].to_numpy(), rows["of"].to_numpy()] = rows["n"].to_numpy()
    broad.destroy()
    return out


def fit(labelled: DataFrame, path: str, sample_texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> Model:
    """Learn from ``doc_id, text, lang``; rows with a null text or lang are left out.

    At most ``sample_texts`` texts of a language, in expectation, chosen by a hash of
    ``doc_id`` and text. More than ``MAX_LANGUAGES`` languages raise ValueError.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    found = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in found]
    total = np.array([r["count"] for r in found], dtype=np.float64)
    prior = np.log(total / total.sum()) if languages else total
    vocabulary = pieces(path)
    if not languages:
        return Model([], prior, np.zeros((vocabulary.size, 0)))
    share = F.create_map(*[x for name, n in zip(languages, total) for x in (F.lit(name), F.lit(min(1.0, sample_texts / n)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang"), F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    from lacuna.llm.storage import written

    words = written(word_counts(labelled.filter(draw < share[F.col("lang")]), languages), "words")
    shares = np.full((vocabulary.size, len(languages)), 1.0 / vocabulary.size)
    for _ in range(rounds):
        counts = expected_counts(words, path, shares) + PRIOR
        shares = counts / counts.sum(axis=0)
    return Model(languages, prior, shares)


def identified(documents: DataFrame, model: Model, path: str) -> DataFrame:
    """All columns of ``documents`` and ``lang_pred, score``, judged from the text alone.

    Columns of those two names in the input are replaced.
    """
    broad = documents.sparkSession.sparkContext.broadcast(model)
    others = [c for c in documents.columns if c not in ("lang_pred", "score")]

    def run(batches):
        scorer = scorer_of(path, broad)
        for block in blocks(batches, owner="lang_id"):
            names, score = scorer(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("text"), pa.array(names, pa.string()), pa.array(score)], ["row", "text", "lang_pred", "score"])

    nested = documents.select(F.struct(*[F.col(f"`{c}`") for c in others if c != "text"]).alias("row"), "text")
    out = nested.mapInArrow(run, nested.select("*").schema.add("lang_pred", "string").add("score", "double"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in others], "lang_pred", "score")


def predict(documents: DataFrame, model: Model, path: str) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the text alone."""
    broad = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = scorer_of(path, broad)
        for block in blocks(batches, owner="lang_id"):
            names, score = scorer(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(documents: DataFrame, model: Model, path: str, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more."""
    found = identified(documents, model, path).filter((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return found.select(*documents.columns)


_SCORERS: dict[int, Scorer] = {}


def scorer_of(path: str, broad) -> Scorer:
    """The worker's scorer for a broadcast model: words scored in one task serve the next."""
    key = broad._jbroadcast.id() if getattr(broad, "_jbroadcast", None) else id(broad.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pieces(path), broad.value)
    return _SCORERS[key]


def _forget() -> None:
    _SCORERS.clear()
    pieces.cache_clear()


FORGET["lang_id"] = _forget
