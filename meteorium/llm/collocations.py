"""Collocations: phrases whose words belong together, from exact counts of all phrases of up to four words.

A first pass counts words and pairs of neighbouring words into a fixed number of buckets by hash and keeps one bit per bucket: whether it
holds ``least`` or more.  A phrase that frequent has frequent words and pairs only, so windows end where a bit is missing; no phrase that
counts is lost, and a full bitmap (very large input) only means that nothing is cut.

Counting itself is by HAT-trie.  Each task keeps, per language, a shallow trie over word ids.  A phrase window (the up to four words that start at
a word and stay in its piece) is counted in a hash container below its first word; a container that grows too large bursts into a node with
one container per next word.  When the tries hold too much, whole subtrees, the largest first, are spilled as runs sorted by their phrase.
The sorted space of windows is cut at fences into prefix ranges; the runs of a range are merged in one stream, in which every shorter
phrase is a prefix that stands together, so all counts fall out of one scan.  A fence may stand inside a frequent prefix, so no range
grows with a hot word; the parts of such a prefix are added up afterwards.  Fences come from a bounded sample and only balance the work.

Edge cases: a null text counts as empty, a null language as ``und``; texts without words give nothing; texts of any length are counted
whole; repeated rows count each time; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import string
import zlib
from bisect import bisect_left
from collections import Counter, _count_elements
from collections.abc import Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .runs import quantile_fences

#: Words of the longest phrase; the key of a window's words after the first has room for three numbers of these bits.
WORDS, BITS = 4, 21
#: Entries of a container beyond which it bursts, and of all containers of a task beyond which subtrees are spilled.
BURST, ROOM = 4096, 600_000
#: Words that a task counts at once, and that it remembers by number before it starts anew (below 2 ** BITS).
STEP, VOCABULARY = 200_000, 800_000
#: Bytes of text behind one prefix range, and the most ranges (beyond, ranges grow: they are merged in steps).
RANGE_BYTES, RANGES = 6_000_000, 20_000
#: Buckets of the first pass (as a power of two), those of one part, and different buckets that a task holds.
BUCKETS, PART, BUCKETS_HELD = 26, 18, 1_500_000
#: Windows that a merge step takes in before it gives away those that no later run can add to.
HELD = 600_000

#: A-Z lower-cased, the marks between pieces as line ends, the tabulator as a blank.
_TEXT = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\x0b\x0c\x0d\x09", string.ascii_lowercase.encode() + b"\n" * 9 + b" ")
_RUN = pa.schema([("lang", pa.string()), ("range_no", pa.int32()), ("first", pa.binary()), ("windows", pa.int64()), ("words", pa.binary()),
                  ("word_bytes", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
_RUN_DDL = "lang string, range_no int, first binary, windows long, words binary, word_bytes long, places binary, counts binary, total long"
_BITS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])
_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("f", pa.int64())])
_END = (b"",) * (WORDS - 1)
_MASK = (1 << BITS) - 1


class _Node(dict):
    """A burst container: next word id -> container or node."""


class _Ids(dict):
    """Numbers of words as they come, from 1, and their hashes by number; the empty word, which ends a piece, is 0."""

    def __init__(self):
        super().__init__({b"": 0})
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(zlib.crc32(word))
        return number

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return ids, np.array(self.hashes, dtype=np.uint64)[ids]


def _bucket(key: np.ndarray, lang: str) -> np.ndarray:
    """Bucket of 64-bit keys of one language."""
    key = (key ^ np.uint64(zlib.crc32(lang.encode()) << 7)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (key >> np.uint64(64 - BUCKETS)).astype(np.int64)


def buckets_of(hashes: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of the pairs that begin with each word but the last."""
    return _bucket(hashes, lang), _bucket((hashes[:-1] << np.uint64(32)) | hashes[1:], lang + "+")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text; empty words end each piece, so that no window leaves it."""
    found: list[bytes] = []
    for piece in text.translate(_TEXT).split(b"\n"):
        words = piece.split()
        if words:
            found += words
            found += _END
    return found


class HatTrie:
    """Counts of phrase windows: first word id -> hash container of the other words, or a node of containers where one has burst."""

    def __init__(self, burst: int = BURST, lang: str = "", frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.top, self.sizes, self.held, self.words, self.burst, self.lang, self.frequent = _Ids(), {}, {}, 0, 0, burst, lang, frequent

    def add(self, words: list[bytes]) -> None:
        """Count the windows at all places of a list of words but the last three; they end before a pair that can't be frequent."""
        ids, hashes = self.ids.numbers(words)
        self.words += int(np.count_nonzero(ids[:-3]))
        first, second, third, fourth = ids[:-3], ids[1:-2], ids[2:-1], ids[3:]
        if self.frequent is not None:
            word, pair = (held[at >> 3] >> (at & 7).astype(np.uint8) & 1 for held, at in zip(self.frequent, buckets_of(hashes, self.lang)))
            first, second = first * word[:-3], second * pair[:-2]
            third, fourth = third * (pair[:-2] & pair[1:-1]), fourth * (pair[:-2] & pair[1:-1] & pair[2:])
        rest = (second << 2 * BITS) | (third << BITS) | fourth
        places = np.flatnonzero(first)
        places = places[np.argsort(first[places])]
        self.held += self._deal(self.top, first[places], rest[places], WORDS - 1, self.sizes)

    def _deal(self, node: dict, first: np.ndarray, rest: np.ndarray, left: int, sizes: dict[int, int] | None = None) -> int:
        """Count windows, sorted by their first word, in the containers below a node; the number of new entries."""
        new, starts = 0, np.flatnonzero(np.diff(first, prepend=-1))
        keys, ends = rest.tolist(), [*starts[1:].tolist(), len(first)]
        for word, start, end in zip(first[starts].tolist(), starts.tolist(), ends):
            box = node.get(word)
            if box is None:
                box = node[word] = {}
            if box.__class__ is _Node:
                inner = np.sort(rest[start:end])
                more = self._deal(box, inner >> (left - 1) * BITS, inner & ((1 << (left - 1) * BITS) - 1), left - 1)
            else:
                more = -len(box)
                _count_elements(box, keys[start:end])
                more += len(box)
                if len(box) > self.burst and left > 1:
                    node[word] = self._split(box, left)
            new += more
            if sizes is not None:
                sizes[word] = sizes.get(word, 0) + more
        return new

    @staticmethod
    def _split(box: dict, left: int) -> _Node:
        node, shift = _Node(), (left - 1) * BITS
        for key, n in box.items():
            node.setdefault(key >> shift, {})[key & ((1 << shift) - 1)] = n
        return node

    def largest(self, entries: int) -> list[int]:
        """First words of the largest subtrees that hold that many entries together."""
        words, sizes = np.array(list(self.sizes), dtype=np.int64), np.array(list(self.sizes.values()), dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        return words[order[:np.searchsorted(np.cumsum(sizes[order]), entries) + 1]].tolist()

    def take(self, firsts: list[int]) -> Run:
        """Remove subtrees; their windows as one sorted run."""
        heads: list[int] = []
        keys: list[int] = []
        counts: list[int] = []
        for a in firsts:
            before = len(keys)
            del self.sizes[a]
            _walk(self.top.pop(a), 0, WORDS - 1, keys, counts)
            heads += [a] * (len(keys) - before)
        self.held -= len(keys)
        rest = np.array(keys, dtype=np.int64)
        ids = np.stack([np.array(heads, dtype=np.int64), rest >> 2 * BITS, (rest >> BITS) & _MASK, rest & _MASK])
        used, at = np.unique(ids, return_inverse=True)
        return in_order([self.ids.words[k] for k in used.tolist()], at.reshape(ids.shape), np.array(counts, dtype=np.int64))


def _walk(box: dict, before: int, left: int, keys: list[int], counts: list[int]) -> None:
    if box.__class__ is _Node:
        for word, below in box.items():
            _walk(below, before | word << (left - 1) * BITS, left - 1, keys, counts)
    elif before:
        keys += [before | k for k in box]
        counts += box.values()
    else:
        keys += box
        counts += box.values()


class Run(NamedTuple):
    """Sorted windows: their words in order (a blank behind each, the empty word first), the place of each window's words, and the counts."""

    words: list[bytes]
    places: np.ndarray
    counts: np.ndarray

    def phrase(self, row: int, size: int = WORDS) -> bytes:
        return b"".join([self.words[k] for k in self.places[:size, row].tolist()])

    def below(self, phrase: bytes) -> int:
        """Number of windows before a phrase."""
        wanted = []
        for word in phrase.split(b" ")[:-1]:
            at = bisect_left(self.words, word + b" ")
            wanted.append(at)
            if at == len(self.words) or self.words[at] != word + b" ":
                break
        low, high = 0, self.places.shape[1]
        for column, at in zip(self.places, wanted + [0] * (WORDS - len(wanted))):
            part = column[low:high]
            low, high = low + int(np.searchsorted(part, at, "left")), low + int(np.searchsorted(part, at, "right"))
        return low

    def part(self, start: int, end: int) -> Run:
        """Some of the windows, with their words only."""
        used, at = np.unique(self.places[:, start:end], return_inverse=True)
        words = [self.words[k] for k in used.tolist()]
        if not words or words[0]:
            words, at = [b"", *words], at + 1
        return Run(words, at.reshape(WORDS, -1), self.counts[start:end])


def in_order(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> Run:
    """A run from different words and windows in any order; equal windows are added up."""
    spaced = [w + b" " if w and w[-1] != 32 else w for w in words]
    order = sorted(range(len(spaced)), key=spaced.__getitem__)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    if not order or spaced[order[0]]:
        order, rank, spaced = [len(spaced), *order], rank + 1, [*spaced, b""]
    a, b, c, d = rank[ids] if ids.size else np.zeros((WORDS, 0), dtype=np.int64)
    high, low = a << 32 | b, c << 32 | d
    at = np.lexsort((low, high))
    high, low, counts = high[at], low[at], counts[at]
    starts = np.flatnonzero((np.diff(high, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0))
    high, low = high[starts], low[starts]
    whole = np.add.reduceat(counts, starts) if len(starts) else counts
    return Run([spaced[k] for k in order], np.stack([high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF]), whole)


def joined(runs: list[Run]) -> Run:
    """Several runs merged into one."""
    words = sorted(set().union(*(r.words for r in runs)))
    number = {w: k for k, w in enumerate(words)}
    ids = [np.fromiter(map(number.__getitem__, r.words), dtype=np.int64, count=len(r.words))[r.places] for r in runs]
    return in_order(words, np.concatenate(ids, axis=1), np.concatenate([r.counts for r in runs]))


def _packed(lang: str, range_no: int, run: Run) -> dict:
    codec, words = pa.Codec("zstd", 1), b"\n".join(run.words)
    return {"total": 0, "lang": lang, "range_no": range_no, "first": run.phrase(0), "windows": len(run.counts), "words": codec.compress(words, asbytes=True), "word_bytes": len(words),
            "places": codec.compress(run.places.astype(np.uint32).tobytes(), asbytes=True), "counts": codec.compress(run.counts.tobytes(), asbytes=True)}


def _unpacked(row: dict) -> Run:
    codec, n = pa.Codec("zstd", 1), row["windows"]
    places = np.frombuffer(codec.decompress(row["places"], n * 4 * WORDS, asbytes=True), dtype=np.uint32).astype(np.int64)
    return Run(codec.decompress(row["words"], row["word_bytes"], asbytes=True).split(b"\n"), places.reshape(WORDS, n),
               np.frombuffer(codec.decompress(row["counts"], n * 8, asbytes=True), dtype=np.int64))


def _cut(lang: str, run: Run, fences: list[bytes]) -> Iterator[dict]:
    """A run cut at the fences of its language; range k lies before fence k."""
    ends = [run.below(f) for f in fences] + [len(run.counts)]
    for k, (start, end) in enumerate(zip([0, *ends], ends)):
        if end > start:
            yield _packed(lang, k, run.part(start, end))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("body")).filter("body IS NOT NULL")


def _lang_fences(texts: DataFrame, range_bytes: int) -> dict[str, list[bytes]]:
    """Windows in order that cut each language's windows into ranges of about equal work, from a bounded sample."""
    total = texts.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    ranges = min(RANGES, -(-total // range_bytes))
    if ranges < 2:
        return {}
    share = min(1.0, 6 * max(50_000, 20 * ranges) / total)  # of the windows, at about six bytes a word

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = [], []
            for lang, body in zip(batch["lang"].to_pylist(), batch["body"].to_pylist()):
                words = words_of(body)
                for k in range(0, len(words) - 3, 10):
                    if words[k]:
                        langs.append(lang)
                        phrases.append(b"".join(w + b" " for w in words[k:k + WORDS] if w))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary())], names=["lang", "phrase"])

    drawn = texts.filter(F.rand(11) < min(1.0, 10 * share)).mapInArrow(sample, "lang string, phrase binary").collect()
    fences: dict[str, list[bytes]] = {}
    for lang, phrase in quantile_fences([(r["lang"], bytes(r["phrase"])) for r in drawn], ranges):
        fences.setdefault(lang, []).append(phrase)
    return fences


def _chunks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words, at most ``step`` at once and the three that follow; texts of a language are put together."""
    waiting: dict[str, list[bytes]] = {}
    n_waiting = 0
    for batch in batches:
        for lang, body in zip(batch["lang"], batch["body"]):
            words = words_of(body.as_py())
            waiting.setdefault(lang.as_py(), []).extend(words)
            n_waiting += len(words)
            if n_waiting > step:
                for at, held in waiting.items():
                    for start in range(0, len(held), step):
                        yield at, held[start:start + step + 3]
                waiting, n_waiting = {}, 0
    for at, held in waiting.items():
        for start in range(0, len(held), step):
            yield at, held[start:start + step + 3]


def frequent_buckets(texts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of fixed size: buckets of words, and of pairs, that hold ``least`` or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codec, n_held = _Ids(), pa.Codec("zstd", 1), 0
        found: tuple[list, list] = ([], [])

        def summed(kind: int) -> tuple[np.ndarray, np.ndarray]:
            buckets, at = np.unique(np.concatenate([b for b, _ in found[kind]]), return_inverse=True)
            return buckets, np.bincount(at, np.concatenate([n for _, n in found[kind]])).astype(np.int64)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if found[kind]:
                    buckets, counts = summed(kind)
                    parts, starts = np.unique(buckets >> PART, return_index=True)
                    for part, start, end in zip(parts.tolist(), starts, [*starts[1:], len(buckets)]):
                        inner, few = (buckets[start:end] - (part << PART)).astype(np.uint32), np.minimum(counts[start:end], least).astype(np.uint32)
                        yield pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "buckets": codec.compress(inner.tobytes(), asbytes=True),
                                                           "counts": codec.compress(few.tobytes(), asbytes=True), "n": end - start}], schema=_BITS)
                    found[kind].clear()

        for lang, words in _chunks(batches, STEP):
            if len(known) > VOCABULARY:
                known = _Ids()
            ids, hashes = known.numbers(words)
            word, pair = buckets_of(hashes, lang)
            here = ids[:-3] > 0
            for kind, buckets in ((0, word[:-3][here]), (1, pair[:-2][here & (ids[1:-2] > 0)])):
                some = np.unique(buckets, return_counts=True)
                found[kind].append(some)
                n_held += len(some[0])
            if n_held > BUCKETS_HELD:
                for kind in (0, 1):
                    found[kind][:] = [summed(kind)]
                n_held = sum(len(found[kind][0][0]) for kind in (0, 1))
                if n_held > BUCKETS_HELD // 2:
                    yield from handed_on()
                    n_held = 0
        yield from handed_on()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        rows = (row for batch in batches for row in batch.to_pylist())
        for (kind, part), group in groupby(rows, lambda row: (row["kind"], row["part"])):
            sums = np.zeros(1 << PART, dtype=np.int64)
            for row in group:
                buckets, counts = (np.frombuffer(codec.decompress(row[c], row["n"] * 4, asbytes=True), dtype=np.uint32) for c in ("buckets", "counts"))
                sums[buckets] += counts
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

    counted = texts.mapInArrow(count, "kind int, part int, buckets binary, counts binary, n long")
    held = (np.zeros(1 << BUCKETS - 3, dtype=np.uint8), np.zeros(1 << BUCKETS - 3, dtype=np.uint8))
    size = 1 << PART - 3
    for row in counted.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(bits, "kind int, part int, bits binary").toLocalIterator():
        held[row["kind"]][row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return held


def sorted_runs(texts: DataFrame, fences: dict[str, list[bytes]], frequent: tuple[np.ndarray, np.ndarray], room: int = ROOM) -> DataFrame:
    """Spilled subtrees of all tasks: lang, range_no, the first window, and the packed words, windows and counts of each run."""

    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # two bitmaps of 2 ** BUCKETS bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        totals: Counter = Counter()

        def spill(share: float) -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                if trie.held:
                    for row in _cut(lang, trie.take(trie.largest(math.ceil(trie.held * share))), fences.get(lang, [])):
                        yield pa.RecordBatch.from_pylist([row], schema=_RUN)

        def emptied() -> Iterator[pa.RecordBatch]:
            yield from spill(1)
            for lang, trie in tries.items():
                totals[lang] += trie.words
            tries.clear()

        for lang, words in _chunks(batches, STEP):
            if sum(len(t.ids) for t in tries.values()) > VOCABULARY:
                yield from emptied()
            trie = tries.get(lang) or tries.setdefault(lang, HatTrie(BURST, lang, shared.value))
            trie.add(words)
            if sum(t.held for t in tries.values()) > room:
                yield from spill(0.5)
        yield from emptied()
        for lang, n in totals.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "range_no": 0, "first": b"", "windows": 0, "words": b"", "word_bytes": 0, "places": b"", "counts": b"", "total": n}],
                                             schema=_RUN)

    return texts.mapInArrow(count, _RUN_DDL)


def _merged(rows: Iterator[dict], most: int) -> Iterator[Run]:
    """Parts in order of the merged runs, which come in the order of their first windows; rows without windows hold totals only."""
    held: list[Run] = []
    n = 0
    for row in rows:
        if n > most:
            run = joined(held)
            whole = run.below(row["first"])
            if whole:
                yield run.part(0, whole)
            held = [run.part(whole, len(run.counts))] if whole < len(run.counts) else []
            n = len(run.counts) - whole
            most = max(most, 2 * n)  # runs that all overlap: take in more of them before the next step
        held.append(_unpacked(row))
        n += row["windows"]
    if held:
        yield joined(held)


def prefix_counts(run: Run, least: int) -> Iterator[tuple[bytes, int, int]]:
    """Phrase, words and count of the prefixes seen ``least`` times or more, and of all that may go on before or after."""
    n = len(run.counts)
    changed = np.zeros(n, dtype=bool)
    changed[0] = True
    for size in range(1, WORDS + 1):
        column = run.places[size - 1]
        changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(run.counts, starts)
        wanted = sums >= least
        wanted[[0, -1]] = True
        wanted &= column[starts] > 0
        for k in np.flatnonzero(wanted).tolist():
            yield run.phrase(starts[k], size)[:-1], size, int(sums[k])


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", range_bytes: int = RANGE_BYTES,
                  room: int = ROOM, held: int = HELD) -> DataFrame:
    """lang, phrase, words and f of all phrases of one to four words seen ``least`` times or more; zero words: f is the number of all words."""
    texts = _texts(docs, text_col, lang_col)
    fences = _lang_fences(texts, range_bytes)
    n_ranges = sum(len(f) + 1 for f in fences.values()) or 1
    runs = sorted_runs(texts, fences, frequent_buckets(texts, least), room).repartition(n_ranges, "lang", "range_no").sortWithinPartitions("lang", "range_no", "first")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        def counted(lang: str, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            phrases, words, counts = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(words, pa.int32()),
                                               pa.array(counts, pa.int64())], schema=_COUNT)

        for (lang, _), group in groupby(rows, lambda row: (row["lang"], row["range_no"])):
            total = 0
            while (row := next(group, None)) is not None and not row["windows"]:  # totals come before windows
                total += row["total"]
            yield counted(lang, [(b"", 0, total)] if total else [])
            for run in _merged(chain([row] if row else [], group), held):
                yield counted(lang, list(prefix_counts(run, least)))

    parts = runs.mapInArrow(merge, "lang string, phrase binary, words int, f long")
    whole = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))
    return whole.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f")


def scored(counts: DataFrame, factor: int = 2_000_000) -> DataFrame:
    """lang, phrase, words, a, l, r and score of each phrase of two words or more, by its lowest-scoring cut (ties: the first)."""
    words = F.split("phrase", " ")
    cuts = counts.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = counts.filter(f"words BETWEEN 1 AND {WORDS - 1}")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {factor}) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words").agg(F.first("a").alias("a"), best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def not_contained(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Without the phrases that stand inside a longer one with at least that share of their count."""
    def inner(size: int) -> Column:
        starts = F.when(F.col("words") > size, F.sequence(F.lit(1), F.col("words") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(F.split("phrase", " "), s, F.lit(size)), " "))

    within = F.array_distinct(F.concat(*(inner(size) for size in range(2, WORDS))))
    longest = phrases.select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {percent}")
    return phrases.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered).drop("longer")


def top_by_lang(phrases: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language by score, count and spelling, with their rank; cut in parts before a language comes together."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, phrases.count() // (20 * top))
    salted = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("part", "place")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first collocations."""
    counts = materialize(phrase_counts(docs, least, text_col, lang_col, **sizes))
    kept = materialize(not_contained(materialize(scored(counts))))
    words = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return top_by_lang(kept, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
