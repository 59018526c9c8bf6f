"""Spelling variants: words one letter apart, and for each rare word the frequent form that it is a variant of.

Words are arranged in a trie by how many letters of each letter group they hold, group after group.  Inserting a letter raises one count,
deleting lowers one, replacing does both or neither; so all words near a given one lie where a search that may spend one surplus and one
deficit gets to, depth first.  At a leaf the words that share the first or the second half of the spelling are verified letter by letter
(one edit leaves one half as it is).

The trie is cut below its first levels: a subtree is a group of a shuffle, and a word visits the subtrees that its budget reaches.  Of two
words the one that is smaller in the group in which they differ first visits the other, so each pair meets once.  Subtrees that hold very
many words are cut once more by halves of the spelling.  More levels are cut off as the vocabulary grows.

Edge cases: a null text has no words and a null id counts as empty text; texts and words of any length are read whole; repeated rows count
each time; ties go to the word that is first in code-point order; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Letters by group, the most telling first; other letters go to three last groups by their code.
GROUPS = ("e", "a", "i", "n", "o", "r", "s", "t", "l", "u", "h", "d", "cm", "pg", "bfv", "kw", "jqxyz")
N_GROUPS = len(GROUPS) + 3
#: Words of a subtree below which it is not cut by halves, and words searched at once.
CUT_AT, AT_ONCE = 600_000, 40_000
#: Different words that a task counts before it hands them on.
COUNTED = 400_000

_GROUP_OF = np.array([next((g for g, letters in enumerate(GROUPS) if chr(c) in letters), len(GROUPS) + c % 3) for c in range(256)], dtype=np.int64)
_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}
_PAIRS = "word string, n_near long, form_n long, form string"


def _stir(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return k ^ (k >> np.uint64(29))


def _weights(n: int) -> np.ndarray:
    return _stir(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


class Spellings:
    """Words of Latin-1 letters: lengths, letter-group counts and hashes of their first and last letters."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(self.sizes)
        codes, owner = np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(np.arange(len(words)), self.sizes)
        self.counts = np.bincount(owner * N_GROUPS + _GROUP_OF[codes], minlength=len(words) * N_GROUPS).reshape(-1, N_GROUPS)
        place = np.arange(len(codes)) - np.repeat(self.ends - self.sizes, self.sizes)
        weight, letters = _weights(int(self.sizes.max()) if len(words) else 0), _stir(codes.astype(np.uint64) + np.uint64(1))
        first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * weight[place], dtype=np.uint64)])
        last = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * weight[np.repeat(self.sizes, self.sizes) - 1 - place], dtype=np.uint64)])
        self._first, self._last = first, last

    def half(self, side: int, shared: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hash of the first (side 0) or last (side 1) letters that stay if an edit at ``shared`` common letters is in the other half."""
        ends = self.ends[rows]
        if side == 0:
            start = ends - self.sizes[rows]
            return self._first[start + shared // 2] - self._first[start]
        return self._last[ends] - self._last[ends - (shared - shared // 2)]


class CountTrie:
    """Stored words by successive group counts; at the leaves by halves of their spelling."""

    def __init__(self, stored: Spellings, rows: np.ndarray):
        self.stored, self.rows, self.levels = stored, rows, []
        counts = stored.counts[rows]
        self.base = int(counts.max(initial=0)) + 2
        node = np.zeros(len(rows), dtype=np.int64)
        for g in range(N_GROUPS):
            children, node = np.unique(node * self.base + counts[:, g], return_inverse=True)
            self.levels.append(children)
        self.at_leaf = {}
        for longer in (0, 1):  # a stored word is met as one of equal or smaller length, or as the longer one
            for side in (0, 1):
                key = self._leaf_key(node, stored.half(side, stored.sizes[rows] - longer, rows))
                order = np.argsort(key, kind="stable")
                self.at_leaf[longer, side] = key[order], order

    @staticmethod
    def _leaf_key(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
        return _stir(leaf.astype(np.uint64) + np.uint64(1)) * np.uint64(3) + half

    def near(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Asked and stored rows of candidate pairs: counts within the budget and one half in common; each pair once."""
        counts, sizes = self.stored.counts, self.stored.sizes
        stack = [(0, 1, 1, asked, np.zeros(len(asked), dtype=np.int64))]
        while stack:
            level, surplus, deficit, who, node = stack.pop()
            if level < N_GROUPS:
                for change in (0, 1, -1)[:1 + surplus + deficit] if surplus else (0, -1)[:1 + deficit]:
                    wanted = counts[who, level] + change
                    key = node * self.base + wanted
                    at = np.minimum(np.searchsorted(self.levels[level], key), len(self.levels[level]) - 1)
                    there = (self.levels[level][at] == key) & (wanted >= 0) & (wanted < self.base)
                    if there.any():
                        stack.append((level + 1, surplus - (change == 1), deficit - (change == -1), who[there], at[there]))
                continue
            longer = int(not surplus and deficit)  # the stored word has one letter more
            shared = sizes[who] - int(surplus and not deficit)
            for side in (0, 1):
                keys, order = self.at_leaf[longer, side]
                key = self._leaf_key(node, self.stored.half(side, shared, who))
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for part in _runs(high - low):
                    n = (high - low)[part]
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    u, v = np.repeat(who[part], n), self.rows[order[np.repeat(low[part], n) + inside]]
                    if side:  # met by the first half already
                        both = np.repeat(shared[part], n)
                        fresh = self.stored.half(0, both, u) != self.stored.half(0, both, v)
                        u, v = u[fresh], v[fresh]
                    yield u, v


def _runs(sizes: np.ndarray, most: int = 500_000) -> Iterator[slice]:
    """Slices whose sizes add up to about ``most``."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        yield slice(start, max(end, start + 1))
        start = max(end, start + 1)


def one_edit(u: bytes, v: bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(u) == len(v):
        return sum(map(ne, u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) != 1:
        return False
    same = next((k for k, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u[same:] == v[same + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least: int = 2) -> DataFrame:
    """word and n: the letter runs of all texts, in one of 31 (by hash of id and run) with a letter taken out."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_letters},}}")  # a shorter run can't give a longer word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for name, text in zip(batch["id"], batch["body"]):
                begin = zlib.crc32(f"{name.as_py()}:".encode())
                lowered: Counter = Counter()
                for run, n in Counter(runs.findall(text.as_py())).items():
                    lowered[run.translate(_LOWER)] += n
                for run, n in lowered.items():
                    h = zlib.crc32(run.encode(), begin)
                    if h % 31 == 0:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                        if len(run) < least_letters:
                            continue
                    found[run] += n
                if len(found) > COUNTED:
                    yield handed_on()
                    found.clear()
        yield handed_on()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("body")).filter("body IS NOT NULL")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


_ROUTED = "block long, side int, asked boolean, words array<binary>, n array<long>"


def _packed(block: np.ndarray, side: int, asked: bool, words: pa.Array, n: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
    """One row per block with its words."""
    order = np.argsort(block, kind="stable")
    blocks, starts = np.unique(block[order], return_index=True)
    offsets = pa.array(np.append(starts, len(order)), pa.int32())
    take = pa.array(rows[order])
    return pa.RecordBatch.from_arrays([pa.array(blocks.view(np.int64)), pa.array(np.full(len(blocks), side, np.int32)), pa.array(np.full(len(blocks), asked)),
                                       pa.ListArray.from_arrays(offsets, words.take(take)), pa.ListArray.from_arrays(offsets, n.take(take))],
                                      names=["block", "side", "asked", "words", "n"])


def _to_subtrees(words: DataFrame, depth: int) -> DataFrame:
    """Each word in its own subtree, and as asked in those that its budget reaches at groups of which the first rises."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _weights(depth)
        for batch in batches:
            column, n = batch["word"], batch["n"]
            spelled = [w.encode("latin-1") for w in column.to_pylist()]
            if not spelled:
                continue
            column, counts = pa.array(spelled, pa.binary()), Spellings(spelled).counts[:, :depth]
            own, rows = (counts.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64), np.arange(len(spelled))
            yield _packed(own, 0, False, column, n, rows)
            reached, who = [], []
            for i in range(depth):
                reached.append(own + weight[i])
                who.append(rows)
                for j in range(i + 1, depth):
                    holds = counts[:, j] > 0
                    reached.append((own + weight[i] - weight[j])[holds])
                    who.append(rows[holds])
            yield _packed(np.concatenate(reached), 0, True, column, n, np.concatenate(who))

    return words.mapInArrow(route, _ROUTED)


def _by_halves(subtrees: DataFrame) -> DataFrame:
    """Subtrees cut by the half of the spelling that an edit leaves as it is; all words are asked in them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, n = batch["words"][k].values, batch["n"][k].values
                spelled = Spellings(words.to_pylist())
                block, rows = np.array([batch["block"][k].as_py()], dtype=np.int64).view(np.uint64), np.arange(len(words))

                def keyed(longer: int, shared: np.ndarray, side: int) -> np.ndarray:
                    return _stir(_stir(block + np.uint64(longer)) + shared.astype(np.uint64)) + spelled.half(side, shared)
                for side in (0, 1):
                    if not batch["asked"][k].as_py():
                        yield _packed(np.concatenate([keyed(0, spelled.sizes, side), keyed(1, spelled.sizes - 1, side)]), side + 1, False, words, n, np.tile(rows, 2))
                    yield _packed(np.concatenate([keyed(0, spelled.sizes, side), keyed(1, spelled.sizes, side), keyed(0, spelled.sizes - 1, side)]), side + 1, True,
                                  words, n, np.tile(rows, 3))

    return subtrees.mapInArrow(route, _ROUTED)


def _search(depth: int):
    """Near words within one subtree: per word their number, and the largest of them."""

    def search(table: pa.Table) -> pa.Table:
        side = table["side"][0].as_py()
        words, n = pc.list_flatten(table["words"]).to_pylist(), pc.list_flatten(table["n"]).to_pylist()
        times, everyone = dict(zip(words, n)), sorted(set(words))
        number = {w: k for k, w in enumerate(everyone)}
        kept = set(pc.list_flatten(table.filter(pc.invert(table["asked"]))["words"]).to_pylist())
        if not kept:
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
        spelled, stored = Spellings(everyone), np.array(sorted(number[w] for w in kept))
        asking = set(pc.list_flatten(table.filter(table["asked"])["words"]).to_pylist()) if side else everyone
        asking = np.array(sorted(number[w] for w in asking), dtype=np.int64)
        trie, prefix, found = CountTrie(spelled, stored), spelled.counts[:, :depth], []
        for start in range(0, len(asking), AT_ONCE):
            for u, v in trie.near(asking[start:start + AT_ONCE]):
                change = prefix[v] - prefix[u]
                first = change[np.arange(len(u)), (change != 0).argmax(axis=1)] if depth else np.zeros(len(u))
                mine = (first > 0) | ((first == 0) & (u < v))
                if side == 2:  # the block of the first half has it
                    shared = np.minimum(spelled.sizes[u], spelled.sizes[v])
                    mine &= spelled.half(0, shared, u) != spelled.half(0, shared, v)
                u, v = u[mine], v[mine]
                near = np.fromiter((one_edit(everyone[a], everyone[b]) for a, b in zip(u.tolist(), v.tolist())), dtype=bool, count=len(u))
                found.append((u[near], v[near]))
        a, b = (np.concatenate([p[k] for p in found] + [p[1 - k] for p in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        size = np.fromiter((times[w] for w in everyone), dtype=np.int64, count=len(everyone))
        order = np.lexsort((b, -size[b], a))
        a, b = a[order], b[order]
        who, start, near = np.unique(a, return_index=True, return_counts=True)
        best = b[start]
        return pa.table({"word": pa.array([everyone[k].decode("latin-1") for k in who], pa.string()), "n_near": pa.array(near.astype(np.int64)),
                         "form_n": pa.array(size[best]), "form": pa.array([everyone[k].decode("latin-1") for k in best], pa.string())})

    return search


def depth_for(words: int) -> int:
    """Levels above the cut: few for a small vocabulary, more with each factor of four."""
    return max(1, min(N_GROUPS, math.ceil(math.log(max(1, words) / 5000, 4)))) if words > 5000 else 1


def near_words(words: DataFrame, cut_at: int = CUT_AT, depth: int | None = None) -> DataFrame:
    """word, n_near, form_n and form: how many words are one edit away, and the most frequent of them, for words that have any."""
    depth = depth or depth_for(words.count())
    blocks = materialize(_to_subtrees(words, depth))
    large = materialize(blocks.groupBy("block").agg(F.sum(F.size("words")).alias("held")).filter(F.col("held") > cut_at).select("block"))
    if not large.isEmpty():
        blocks = blocks.join(large, "block", "left_anti").unionByName(_by_halves(blocks.join(large, "block", "left_semi")))
    found = blocks.groupBy("block", "side").applyInArrow(_search(depth), _PAIRS)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and the last word of its chain of forms; each round doubles the steps, and a form has ten times the count of its word."""
    chain = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return chain


def variants(words: DataFrame, factor: int = 10, **sizes: int) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word of a table of words and counts."""
    near = materialize(words.join(near_words(words, **sizes), "word", "left"))
    rare = F.col("form_n") >= factor * F.col("n")
    named = near.select("word", "n", F.when(rare, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(rare, F.col("form_n")).alias("form_n"))
    roots = _roots(named.filter("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(materialize(word_counts(docs, id_col, text_col)), **sizes)
