"""Language of a text: known words by their log frequency per language, unseen words by ever shorter character n-grams.

The model is fitted on at most about ``max_docs`` labelled documents (an even hash sample where there are more) and keeps the
``max_words`` most frequent words and ``max_grams`` most frequent n-grams; both bounds are its size on every executor.
Every text is scored whole.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; where nothing could be learned all texts are; texts
with letters but nothing known get the most frequent language; equal sums go to the first language by name; documents without a
label are not learned from; rows that repeat count as often as they stand; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, text_batches
from .words import LETTER_BYTES, WordRows, by_size, grams, lowered

ORDERS = range(1, 6)
#: Letters from which on a known n-gram tells something of a word; columns that ``predict`` adds.
TELLING, ADDED = 3, ("lang_pred", "score", "heard")
#: Letters (in words) that are scored together.
RUN_CHARS = 500_000


def even_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of the id; all rows where there are no more."""
    n = rows.select(id_col).count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def word_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """label, word and number over all given documents."""
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(label, Counter()).update(lowered(text, LETTER_BYTES))
        for label, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                                             names=["label", "word", "n"])

    return (docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).mapInArrow(count, "label string, word binary, n long")
            .groupBy("label", "word").agg(F.sum("n").alias("n")))


class Counts:
    """Sorted rows of label, word and number, held as an Arrow table and turned into tuples some at a time."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([(c, "ascending") for c in table.column_names])

    def __iter__(self) -> Iterator[tuple[str, bytes, int]]:
        for batch in self.table.to_batches(max_chunksize=10_000):
            yield from zip(*(column.to_pylist() for column in batch.columns))


class Model:
    """Languages, log share of each, rows of known words, and hashes and rows of known n-grams by order."""

    def __init__(self, counts: Iterable[tuple[str, bytes, int]], docs: dict[str, int], max_grams: int | None, alpha: float = 0.1, words: dict[str, int] | None = None):
        """``counts`` (gone through twice) has every label's count of each known word; ``words`` the number of all words of a label (by default of the known ones)."""
        self.languages = sorted(docs)
        number = {x: k for k, x in enumerate(self.languages)}
        share = np.array([docs[x] for x in self.languages], dtype=float)
        self.prior = np.log(share / share.sum()) if len(share) else share
        self.known = {w: k for k, w in enumerate(dict.fromkeys(w for _, w, _ in counts))}
        table = np.zeros((len(self.known), len(self.languages)))
        for label, word, n in counts:
            table[self.known[word], number[label]] += n
        whole = np.array([words[x] for x in self.languages], dtype=float) if words is not None and len(table) else table.sum(axis=0)
        self.words = np.concatenate([self._evidence(table, alpha, whole), np.ones((len(table), 1), dtype=np.float32)], axis=1)
        self.grams = {}
        if not len(table):
            return
        for n, owner, _, h in grams(list(self.known), ORDERS):
            keys, place = np.unique(h, return_inverse=True)
            sums = np.stack([np.bincount(place, weights=table[owner, k], minlength=len(keys)) for k in range(table.shape[1])], axis=1)
            whole = sums.sum(axis=0)
            if max_grams is not None and len(keys) > max_grams // len(ORDERS):
                best = np.sort(np.argsort(-sums.sum(axis=1), kind="stable")[:max_grams // len(ORDERS)])
                keys, sums = keys[best], sums[best]
            self.grams[n] = (keys, self._evidence(sums, alpha, whole))

    @staticmethod
    def _evidence(table: np.ndarray, alpha: float, whole: np.ndarray) -> np.ndarray:
        """Log frequency in each language (out of ``whole``), less the mean over languages."""
        logs = np.log((table + alpha) / (whole + alpha * max(1, len(table))))
        return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if len(table) else logs.astype(np.float32)

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Mean evidence over the letters of each word, which speak through the longest known n-gram that begins there; last, whether a
        known n-gram of ``TELLING`` letters or more is in the word."""
        out, said, heard = np.zeros((len(words), len(self.languages))), np.zeros(len(words)), np.zeros((len(words), 1))
        taken: np.ndarray | None = None
        for n, owner, at, h in reversed(list(grams(words, ORDERS))):
            keys, rows = self.grams.get(n, (np.zeros(0, dtype=np.uint64), None))
            if taken is None:
                taken = np.zeros(sum(len(w.decode("utf-8", "replace")) + 2 for w in words), dtype=bool)
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            new = (keys[place] == h) & ~taken[at]
            taken[at[new]] = True
            if n >= TELLING:
                heard[owner[new]] = 1
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(owner[new], weights=rows[place[new], k], minlength=len(words))
            said += np.bincount(owner[new], minlength=len(words))
        return np.concatenate([out / np.maximum(said, 1)[:, None], heard], axis=1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_docs: int = 20_000,
        max_words: int | None = 100_000, max_grams: int | None = 250_000) -> Model:
    """Learn from the documents that have a label and a text; without bounds all words and n-grams of the sample are kept."""
    usable = even_sample(labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()), id_col, max_docs)
    docs = {str(r["label"]): r["n"] for r in usable.groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = materialize(word_counts(usable, text_col, label_col))
    known = counts
    if max_words is not None:  # words by their count in all languages, each with all its counts
        known = counts.join(counts.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(max_words), "word")
    found = Counts(known.select("label", "word", "n").toArrow())
    words = dict.fromkeys(docs, 0) | {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return Model(found, docs, max_grams, words=words)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None, heard: bool = False) -> DataFrame:
    """The kept columns (all, if none are named) with ``lang_pred`` and ``score``, the share of the predicted language.

    If asked for, ``heard`` follows: the share of the text's words that are known or hold a telling known n-gram (null where nothing
    was learned).  Columns that already have one of these names are replaced.
    """
    added = ADDED[:3 if heard else 2]
    text_batches(docs.sparkSession)
    named = keep if keep is not None else [F.col(c) for c in docs.columns if c.lower() not in added]
    out = docs.select(*named).schema.add("lang_pred", "string").add("score", "double")
    out = out.add("heard", "double") if heard else out
    width, sent = len(named), docs.sparkSession.sparkContext.broadcast(vars(model))
    inside = keep is None and text_col.lower() not in added  # then the text travels once, as one of the kept columns
    kept = docs.select(*named) if inside else docs.select(*named, F.col(text_col).alias(free_name(docs, "whole_text")))
    place = kept.columns.index(text_col) if inside else width

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        vars(m).update(sent.value)
        n = len(m.languages)
        rows = WordRows(m.known, m.words, m.unseen)
        for batch in batches:
            said, sure, share = [], [], []
            for run in by_size(iter(batch.column(place).to_pylist()), lambda t: len(t or ""), RUN_CHARS):
                letters = [bool(m.languages) and any(map(str.isalpha, text or "")) for text in run]
                found = rows.numbers([lowered(text, LETTER_BYTES) if some else [] for text, some in zip(run, letters)])
                for numbers, some in zip(found, letters):
                    if not some:
                        said.append("und")
                        sure.append(0.0)
                        share.append(0.0 if n else None)
                        continue
                    found_rows = rows.matrix[numbers]
                    total = found_rows[:, :n].sum(axis=0, dtype=np.float64) + m.prior
                    share.append(float(found_rows[:, n].mean()) if len(numbers) else 0.0)
                    best = int(np.argmax(total))
                    said.append(m.languages[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(share, pa.float64())][:len(out)], names=out.names)

    return kept.mapInArrow(label, out)
