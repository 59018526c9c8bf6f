"""Toxicity of a text: averaged subword embeddings under a linear softmax, trained together in numpy.

A word is the mean of the vectors of its character n-grams and of itself, so unseen misspellings share most of their vectors with
the word they come from.  A bag is the mean of the word vectors of a passage; passages of ``2 * HALF`` words overlap by half and cover the
whole text.  Bags go through a linear softmax (of two labels: one linear form); embeddings and softmax are trained together.  A text is as
toxic as its worst passages: in training a document without the label teaches all its bags, one with the label only its worst one
(all of them in the first rounds).  The score is a logistic form of the worst bag, of the bag of the whole text and of the
logarithm of the number of passages, since the worst of many clean passages lies higher than that of one.  It is fitted on documents that
the embeddings have not seen, alone and joined to long texts.

Training takes at most about ``max_each`` documents of each label and ``max_chars`` letters of them (even hash samples where there
are more).  Every text is scored whole.

Edge cases: null, empty and wordless texts count as one passage that says nothing; where one of the two labels is missing the
score is the share of label 1 (0 without labels); labels that are null or neither 0 nor 1 are not learned from; a document that
has both labels teaches both; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import materialize
from .common import free_name, text_batches
from .language import even_sample
from .words import TOKEN_BYTES, WordRows, by_size, grams, lowered

ORDERS = range(3, 7)
BUCKETS = 1 << 17
DIM = 4
#: Words of half a passage.
HALF = 2
#: Numbers of documents that are joined to long texts for the last step.
JOINED = (4, 16, 64, 256)
RUN_CHARS = 500_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the subwords of all words, and the word of each; a word is a subword of itself."""
    owners, buckets = [np.arange(len(words))], []
    own = np.fromiter((xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    buckets.append(own % np.uint64(BUCKETS))
    for _, owner, _, h in grams(words, ORDERS):
        owners.append(owner)
        buckets.append(h % np.uint64(BUCKETS))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _means(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))


def halves(n: int) -> np.ndarray:
    """First words of the half passages of a text of n words."""
    return np.arange(0, max(1, n), HALF)


class Model:
    """Embeddings under the softmax, folded into one number a bucket, and the logistic form of a text's passages."""

    def __init__(self, weights: np.ndarray, bias: float, form: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)):
        self.weights, self.bias, self.form = weights, bias, form

    def unseen(self, words: list[bytes]) -> np.ndarray:
        buckets, owner = subwords(words)
        return _means(owner, self.weights[buckets], len(words))

    def features(self, scores: np.ndarray) -> tuple[float, float, float, float]:
        """Worst passage, whole text, logarithm of the number of passages, and 1, from the scores of a text's words in order."""
        if not len(scores):
            return self.bias, self.bias, 0.0, 1.0
        firsts = halves(len(scores))
        sums, sizes = np.add.reduceat(scores, firsts), np.diff(np.append(firsts, len(scores)))
        if len(sums) > 1:
            sums, sizes = sums[1:] + sums[:-1], sizes[1:] + sizes[:-1]
        return float((sums / sizes).max()) + self.bias, float(scores.mean()) + self.bias, math.log(len(sums)), 1.0

    def probability(self, features: tuple[float, ...]) -> float:
        return float(_sigmoid(np.float64(np.dot(self.form, features))))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.first, self.second, self.t = rate, 0.0, 0.0, 0

    def step(self, value, slope):
        self.t += 1
        self.first, self.second = 0.9 * self.first + 0.1 * slope, 0.999 * self.second + 0.001 * slope * slope
        return value - self.rate * (self.first / (1 - 0.9 ** self.t)) / (np.sqrt(self.second / (1 - 0.999 ** self.t)) + 1e-8)


def _embed(texts: list[list[bytes]], labels: np.ndarray, rounds: int = 60, warm: int = 30, rate: float = 0.3, penalty: float = 1e-6) -> Model:
    """Embeddings and softmax by gradient steps over all passages of all texts."""
    rows = WordRows({}, np.zeros((0, 1)), lambda new: np.zeros((len(new), 1)), room=1 << 60)
    numbers = [n for n in rows.numbers(texts)]
    n = len(rows)
    buckets, owner = subwords(list(rows))
    parts = np.bincount(owner, minlength=n)
    firsts = [halves(len(x)) for x in numbers]
    flat = np.concatenate(numbers)
    half_sizes = np.concatenate([np.diff(np.append(f, len(x))) for f, x in zip(firsts, numbers)])
    half_of = np.repeat(np.arange(len(half_sizes)), half_sizes)
    # a passage is a half and the next one; the only half of a short text is a passage
    counts = np.array([max(1, len(f) - 1) for f in firsts])
    doc, first_bag = np.repeat(np.arange(len(numbers)), counts), np.concatenate([[0], np.cumsum(counts)[:-1]])
    first_half = np.concatenate([[0], np.cumsum([len(f) for f in firsts])[:-1]])
    low = first_half[doc] + np.arange(len(doc)) - first_bag[doc]
    two = np.array([len(f) > 1 for f in firsts])[doc]
    sizes = np.maximum(1, half_sizes[low] + np.where(two, half_sizes[np.minimum(low + 1, len(half_sizes) - 1)], 0))
    target = labels[doc]
    # each label weighs the same, each document of a label too, however many passages it has
    balance = (0.5 / np.where(labels == 1, labels.sum(), (1 - labels).sum()))[doc]

    def bags(values: np.ndarray) -> np.ndarray:
        by_half = np.bincount(half_of, weights=values[flat], minlength=len(half_sizes))
        return (by_half[low] + np.where(two, by_half[np.minimum(low + 1, len(by_half) - 1)], 0)) / sizes

    random = np.random.default_rng(7)
    table, soft, bias = random.normal(0, 0.05, (DIM, BUCKETS)), random.normal(0, 0.5, DIM), 0.0
    steps = [_Adam(rate), _Adam(rate / 10), _Adam(rate / 3)]
    for k in range(rounds):
        mean = np.stack([bags(_means(owner, row[buckets], n)) for row in table])
        said = soft @ mean + bias
        if k < warm:
            taught = balance / counts[doc]
        else:
            worst = said >= np.maximum.reduceat(said, first_bag)[doc]
            share = worst / np.bincount(doc[worst], minlength=len(counts))[doc]
            taught = balance * np.where(target == 1, share, 1 / counts[doc] + share)
        slope = (_sigmoid(said) - target) * taught
        back = slope / sizes
        by_half = np.bincount(low, weights=back, minlength=len(half_sizes)) + np.bincount((low + 1)[two], weights=back[two], minlength=len(half_sizes))
        word_slope = np.bincount(flat, weights=by_half[half_of], minlength=n)
        per_bucket = np.bincount(buckets, weights=(word_slope / parts)[owner], minlength=BUCKETS)
        turns = soft[:, None] * per_bucket[None, :] + penalty * table, mean @ slope, slope.sum()
        table, soft, bias = (step.step(value, turn) for step, value, turn in zip(steps, (table, soft, bias), turns))
    return Model(soft @ table, float(bias))


def _form(x: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic form by Newton steps, held back a little so that clean separation stays finite."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w)), x.T @ (p - labels) + 0.02 * w)
    return tuple(w.tolist())


def _joined(scores: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Long texts out of documents: of clean ones alone, and of clean ones around one with the label."""
    random = np.random.default_rng(11)
    clean, toxic = ([scores[k] for k in np.flatnonzero(labels == label)] for label in (0, 1))
    texts, marks = [], []
    for size in JOINED:
        for k in range(min(30, len(clean) // 2)):
            some = [clean[i] for i in random.integers(0, len(clean), size)]
            texts.append(np.concatenate(some))
            marks.append(0)
            if toxic and size <= 16:
                some[int(random.integers(0, size))] = toxic[k % len(toxic)]
                texts.append(np.concatenate(some))
                marks.append(1)
    return texts, marks


def train(texts: list[str | None], labels: np.ndarray) -> Model:
    """Fit embeddings and softmax to whole texts; the form on the third that a first fit has not seen."""
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0, 0.0, -50.0 if share == 0 else 50.0))
    split = [lowered(t, TOKEN_BYTES) for t in texts]
    # every third document of each label, in the order given
    rank = np.empty(len(labels), dtype=np.int64)
    for k in (0, 1):
        rank[labels == k] = np.arange((labels == k).sum())
    away, model = rank % 3 == 2, _embed(split, labels)
    first = _embed([t for t, out in zip(split, away) if not out], labels[~away]) if labels[away].any() else model
    seen = away if labels[away].any() else np.ones(len(labels), dtype=bool)
    scores = [first.unseen(t) if t else np.zeros(0) for t, out in zip(split, seen) if out]
    long, marks = _joined(scores, labels[seen])
    model.form = _form(np.array([first.features(s) for s in scores + long]), np.concatenate([labels[seen], np.array(marks, dtype=np.int64)]))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = 1_500,
        max_chars: int = 8_000_000) -> Model:
    """Learn from the labelled documents; the chosen ids are at most a few thousand, so documents are filtered where they stand."""
    named = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    chosen = [even_sample(named.filter(F.col("_label") == k), id_col, max_each) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = materialize(docs.select(id_col, text_col).join(picked, id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_label").alias("label")).distinct())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    share = F.pmod(F.xxhash64("id", "text", F.lit("chars")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_chars / max(1, chars)))
    rows = rows.filter(share).collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["text"] or ""))
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) with ``score``, the probability of label 1; it replaces a column of that name."""
    text_batches(docs.sparkSession)
    named = keep if keep is not None else [F.col(c) for c in docs.columns if c.lower() != "score"]
    out = docs.select(*named).schema.add("score", "double")
    width, sent = len(named), docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.form))
    kept = docs.select(*named, F.col(text_col).alias(free_name(docs, "whole_text")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        rows = WordRows({}, np.zeros(0), m.unseen)
        for batch in batches:
            said = []
            for run in by_size(iter(batch.column(width).to_pylist()), lambda t: len(t or ""), RUN_CHARS):
                for numbers in rows.numbers([lowered(t, TOKEN_BYTES) for t in run]):
                    said.append(m.probability(m.features(rows.matrix[numbers])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(said, pa.float64())], names=out.names)

    return kept.mapInArrow(judge, out)
