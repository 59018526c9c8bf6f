"""Jaccard self-join of word n-gram sets with prefix trees, down to connected components.

Sets are sorted by one global order of the n-grams (their 64-bit hash).  Equal sets are one class; only class representatives go on.

* Blocks.  Representatives of like size are cut by n-gram hash into parts.  Of these, as many are used as there are n-grams in which
  linked sets can differ, and at least one more, so that linked sets agree on at least one whole part.  A part that two sets share is a
  block.  Parts hold several n-grams, so a frequent n-gram or passage alone makes no block.
* Own n-grams.  An n-gram that only one member of all blocks has is in no partner.  A member with too many of its own has no partner at all;
  and two members can't link if their own n-grams alone keep them apart.
* Trees.  Sets are stored in a prefix tree; another set walks it, sharing the partial overlap along common beginnings and leaving
  subtrees that can't reach the overlap even if all that remains of both sets agreed.
* Hubs.  In each block the member with the fewest n-grams of its own, the likeliest centre, walks trees of the others.  What links to it is
  one component, so a block of many near copies mostly costs one walk through its members, not one comparison per pair.
* Tiles.  Blocks that still lie in several components are gathered into clusters, clusters are dealt into tiles of bounded size, and each pair of
  tiles is joined by trees, passing over members that are in one component already.  So no link between components is missed.

Edge cases: null texts and texts without words have the empty set and link with nothing, not even with each other; a text of fewer
words than an n-gram is one n-gram; rows that repeat are one class; rows that share an id are one node; rows without an id can't be
named and are left out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ..session import materialize, release, small
from .common import text_batches
from .components import components
from .words import by_size

#: Sets of one tree at most.
TREE = 256
#: N-grams and sets of one tile, about.
TILE_NGRAMS = 250_000
TILE_SETS = 500
RUN_CHARS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxh3_64_intdigest(word)
        return value


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return h ^ (h >> np.uint64(28))


def ngram_set(text: bytes | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of lower-cased words (A-Z only; words end at ASCII blanks)."""
    split = text.lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, split), dtype=np.uint64, count=len(split))
    width = min(words, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _stir(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(out)


def _differing(sizes, high, percent: int):
    """The most n-grams in which a set of this size can differ from a linked set that is no smaller and no larger than ``high``."""
    return (sizes + np.minimum(sizes * 100 // percent, high)) * (100 - percent) // (100 + percent)


def size_classes(percent: int, upto: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, parts, spare parts) of the size classes up to the one that holds ``upto``.

    Spare parts, about as many as are empty in a small set of the class, make up for parts that are empty in both of two sets.
    """
    out, low = [], 1
    while not out or out[-1][1] < upto:
        high = 2 * low
        parts, used = int(_differing(high, high, percent)) + 1, int(_differing(low, high, percent)) + 1
        spare = math.ceil(1.5 * used * math.exp(-low / parts)) if parts > 1 else 0
        out.append((low, high, parts + spare, spare))
        low = high + 1
    return out


def block_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Keys of the used parts of each set, in its own size class and in those of larger partners.

    The parts are used in one order, so of two linked sets both use all that the smaller one uses, and they agree on one more of these
    than there are spare parts.  Keys of empty parts are left out unless the set has so many that they could be all it shares.
    """
    classes = size_classes(percent, max((len(s) for s in sets), default=0) * 100 // percent + 1)
    jobs = []  # set, class
    for i, s in enumerate(sets):
        jobs += [(i, c) for c, (low, high, _, _) in enumerate(classes) if len(s) and high >= len(s) and low * percent <= len(s) * 100]
    if not jobs:
        return [np.zeros(0, dtype=np.uint64) for _ in sets]
    which, cls = np.array(jobs).T
    high, parts, spare = (np.array([classes[c][k] for c in cls]) for k in (1, 2, 3))
    sizes = np.array([len(sets[i]) for i in which])
    used = _differing(sizes, high, percent) + 1 + spare
    grams, job = np.concatenate([sets[i] for i in which]), np.repeat(np.arange(len(jobs)), sizes)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    part = first[job] + (_stir(grams + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % parts[job]
    sums, held = np.zeros(parts.sum(), dtype=np.uint64), np.bincount(part, minlength=parts.sum())
    np.add.at(sums, part, _stir(grams))
    of = np.repeat(np.arange(len(jobs)), parts)
    number = np.arange(len(sums)) - first[of]
    keys = _stir(sums + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (cls[of].astype(np.uint64) << np.uint64(40)))
    inside = number < used[of]
    empty = np.bincount(of, weights=(held == 0) & inside, minlength=len(jobs))
    use = inside & ((held > 0) | (empty > spare)[of])
    owner = which[of]
    order = np.argsort(owner[use], kind="stable")
    ends = np.cumsum(np.bincount(owner[use], minlength=len(sets)))
    return np.split(keys[use][order], ends[:-1])


class Tree:
    """Prefix tree over sorted sets; a node holds the run of n-grams that all its sets go on with."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(order, 0)
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            end, rest = node["end"], [i for i in node["ids"] if len(sets[i]) > node["end"]]
            node["leaves"] = [i for i in node["ids"] if len(sets[i]) == end]
            start = 0
            for k in range(1, len(rest) + 1):
                if k == len(rest) or sets[rest[k]][end] != sets[rest[start]][end]:
                    node["below"].append(self._node(rest[start:k], end))
                    start = k
            waiting += node["below"]

    def _node(self, ids: list[int], start: int) -> dict:
        a, b = self.sets[ids[0]], self.sets[ids[-1]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[start:n] != b[start:n])
        end = start + int(differ[0]) if len(differ) else n
        sizes = [len(self.sets[i]) for i in ids]
        return {"ids": ids, "run": a[start:end], "end": end, "below": [], "least": min(sizes), "most": max(sizes)}

    def linked(self, asked: np.ndarray, percent: int, skip: Callable[[int], bool] | None = None) -> list[tuple[int, int]]:
        """(set number, overlap) of the sets whose Jaccard similarity to the asked one is at least percent / 100.

        Branches that end in a single set are left at once if ``skip`` says so of that set.
        """
        out, waiting = [], [(self.root, 0, 0)]
        while waiting:
            node, overlap, passed = waiting.pop()
            if skip is not None and len(node["ids"]) == 1 and skip(node["ids"][0]):
                continue
            run = node["run"]
            if len(run):
                place = np.searchsorted(asked, run)
                overlap += int((asked[np.minimum(place, len(asked) - 1)] == run).sum())
                passed = int(np.searchsorted(asked, run[-1], side="right"))
            reach = overlap + min(node["most"] - node["end"], len(asked) - passed)
            if reach * (100 + percent) < percent * (len(asked) + node["least"]):
                continue
            out += [(i, overlap) for i in node["leaves"] if overlap * (100 + percent) >= percent * (len(asked) + len(self.sets[i]))]
            waiting += [(child, overlap, passed) for child in node["below"]]
        return out


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """id, n (size of the set), digest of the set (null if empty) and block keys of every document."""
    kind = docs.schema[id_col].dataType
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for rows in by_size(zip(batch.column(0), batch.column(1).to_pylist()), lambda r: len(r[1] or b""), RUN_CHARS):
                if len(hashes) > 1_000_000:
                    hashes.clear()
                sets = [ngram_set(text, words, hashes) for _, text in rows]
                keys = block_keys(sets, percent)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.as_py() for one, _ in rows], batch.schema.field(0).type), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))], names=["id", "n", "digest", "keys"])

    return (docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, f"id {kind.simpleString()}, n long, digest binary, keys array<long>"))


def _walks(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) among pairs (hub, other), found by walks of each hub through trees of its others."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("trees"))
    dealt = materialize(pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("trees")).alias("tree"), "other"))
    hubs = dealt.select("hub", "tree", F.lit(0).alias("kind"), F.col("hub").alias("id")).distinct()
    roles = materialize(hubs.unionByName(dealt.select("hub", "tree", F.lit(1).alias("kind"), F.col("other").alias("id"))))
    held = small(roles).join(texts, "id").select("hub", "tree", "kind", "id", "digest", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def walk(hub, hubs: list[np.ndarray], others: list[tuple]) -> list[tuple]:
        if not hubs or not others:
            return []
        tree = Tree([s for _, s in others])
        return sorted({(hub, others[i][0]) for h in hubs for i, _ in tree.linked(h, percent)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, hubs, others, found = _WordHashes(), None, [], [], []
        for batch in batches:
            if len(hashes) > 1_000_000:
                hashes.clear()
            for hub, tree, role, one, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, tree) != at:
                    found += walk(at and at[0], hubs, others)
                    at, hubs, others = (hub, tree), [], []
                s = ngram_set(text, words, hashes)
                if xxh3_128_digest(s.tobytes()) != digest:
                    continue  # another text under the same id, which is not the representative of this class
                if role == 0:
                    hubs.append(s)
                else:
                    others.append((one, s))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], batch.schema.field(0).type) for k in (0, 1)], names=["u", "v"])
            found = []
        last = walk(at and at[0], hubs, others)
        if last:
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in last])

    return held.repartition("hub", "tree").sortWithinPartitions("hub", "tree", "kind").mapInArrow(run, f"u {kind}, v {kind}")


def _own_ngrams(texts: DataFrame, words: int) -> DataFrame:
    """id and own (the number of n-grams that no other row has) of the texts' sets; ids without any are left out."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for rows in by_size(zip(*(batch.column(k).to_pylist() for k in range(3))), lambda r: len(r[1] or b""), RUN_CHARS):
                if len(hashes) > 1_000_000:
                    hashes.clear()
                made = [(one, s) for one, text, digest in rows for s in [ngram_set(text, words, hashes)] if xxh3_128_digest(s.tobytes()) == digest]
                ids, sets = [one for one, _ in made], [s for _, s in made]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                owner = pa.array(ids, batch.schema.field(0).type).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64))], names=["id", "ngram"])

    held = texts.select("id", "text", "digest").mapInArrow(run, f"id {kind}, ngram long")
    once = held.groupBy("ngram").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id"))
    return once.filter("times = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _may_link(a: dict, b: dict, percent: int):
    """Whether two sizes, less what only one of the two has, leave enough to share; an id with several sets (no size) may always."""
    most = F.least(a["n"] - a["own"], b["n"] - b["own"])
    return F.coalesce(most * (100 + percent) >= percent * (a["n"] + b["n"]), F.lit(True))


def _side(prefix: str) -> dict:
    return {"n": F.col(f"{prefix}n"), "own": F.col(f"{prefix}own")}


def _blocks(members: DataFrame) -> DataFrame:
    """key, size and first hub of the blocks of two or more members."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "id", "n")).alias("hub")).filter("size > 1").select(
        "key", "size", F.col("hub.id").alias("hub"), F.col("hub.own").alias("hub_own"), F.col("hub.n").alias("hub_n"))


def _open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, id, n, own and part (component so far) of the members of blocks that lie in several components."""
    labelled = members.join(parts, F.col("id") == F.col("node"), "left").select("key", "id", "n", "own", F.coalesce("component", "id").alias("part"))
    spread = labelled.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a != b").select("key")
    return labelled.join(spread, "key", "left_semi")


def _tiles(opened: DataFrame) -> DataFrame:
    """cluster, a, b, tile, id, n, own and part: each member of a cluster of open blocks, once for every pair (a, b) of tiles with its own."""
    first = opened.groupBy("key").agg(F.min("id").alias("v"))
    cluster = components(opened.select("key", F.col("id").alias("u")).join(first, "key").select("u", "v"))
    rows = materialize(opened.select("id", "n", "own", "part").distinct().join(cluster, F.col("id") == F.col("node")).drop("node").withColumnRenamed("component", "cluster"))
    count = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(F.coalesce("n", F.lit(1))) / TILE_NGRAMS), F.ceil(F.count(F.lit(1)) / TILE_SETS)).alias("tiles"))
    dealt = rows.join(count, "cluster").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return dealt.select("cluster", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "tile", "id", "n", "own", "part")


def _tile_links(tiles: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between members of different components, from the trees of each pair of tiles; as many as tie all that is linked."""
    kind = texts.schema["id"].dataType.simpleString()
    held = tiles.join(texts, "id").select("cluster", "a", "b", "tile", "id", "own", "part", "digest", "text")

    def join(rows: list[tuple]) -> list[tuple]:
        """rows: (tile, id, own, part, set) of one pair of tiles."""
        lead = {r[3]: r[3] for r in rows}

        def find(x):
            while lead[x] != x:
                lead[x] = lead[lead[x]]
                x = lead[x]
            return x
        low = min(r[0] for r in rows)
        asking, stored = [r for r in rows if r[0] == low], [r for r in rows if r[0] != low] or rows
        tree, out = Tree([r[4] for r in stored]), []
        for _, one, own, part, s in asking:
            def skip(i, mine=find(part), left=len(s) - own, size=len(s)):
                _, _, o, p, t = stored[i]
                return find(p) == mine or min(left, len(t) - o) * (100 + percent) < percent * (size + len(t))
            for i, _ in tree.linked(s, percent, skip):
                x, y = find(part), find(stored[i][3])
                if x != y:
                    lead[max(x, y)] = min(x, y)
                    out.append((one, stored[i][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, rows, found = _WordHashes(), None, [], []
        for batch in batches:
            if len(hashes) > 1_000_000:
                hashes.clear()
            for cluster, a, b, tile, one, own, part, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, a, b) != at:
                    found += join(rows) if rows else []
                    at, rows = (cluster, a, b), []
                s = ngram_set(text, words, hashes)
                if xxh3_128_digest(s.tobytes()) == digest:
                    rows.append((tile, one, own, part, s))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], batch.schema.field(4).type) for k in (0, 1)], names=["u", "v"])
            found = []
        if rows:
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in join(rows)], schema=pa.schema([("u", batch.schema.field(4).type), ("v", batch.schema.field(4).type)]))

    return held.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach, itself included) of every document."""
    spark = docs.sparkSession
    with_keys = materialize(shingled(docs, id_col, text_col, words, percent))
    table = materialize(with_keys.select("id", "n", "digest").distinct())
    classes = materialize(table.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")))
    keys = with_keys.join(classes, ["id", "digest"], "left_semi").select("id", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"))
    members = materialize(keys.join(shared.hint("shuffle_hash"), "key"))
    release(spark, with_keys, shared)
    first_members = members
    wanted = materialize(members.select("id").distinct().join(classes, "id"))
    texts = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(small(wanted, 16), "id"))
    same_id = classes.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("id")
    own = materialize(_own_ngrams(texts, words).join(same_id, "id", "left_anti"))  # counts of several sets under one id would add up
    sizes = table.join(classes, ["id", "digest"], "left_semi").groupBy("id").agg(F.when(F.min("digest") == F.max("digest"), F.max("n")).alias("n"))
    members = (members.distinct().join(sizes, "id").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
               .filter(F.coalesce((F.col("n") - F.col("own")) * 100 >= percent * F.col("n"), F.lit(True))))
    members = materialize(members)
    release(spark, first_members, own)
    alone, members = members, materialize(members.join(_blocks(members), "key").drop("size"))
    release(spark, alone)
    pairs = materialize(members.filter((F.col("id") != F.col("hub")) & _may_link(_side("hub_"), _side(""), percent)).select("hub", F.col("id").alias("other")).distinct())
    parts = materialize(components(_walks(pairs, texts, words, percent)))
    release(spark, pairs)
    opened = materialize(_open_members(members, parts))
    if not opened.isEmpty():
        fresh = _tile_links(_tiles(opened), texts, words, percent)
        parts = materialize(components(fresh.unionByName(parts.select(F.col("node").alias("u"), F.col("component").alias("v")))))
    release(spark, texts, members, opened)
    reps = classes.withColumnRenamed("id", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    per_row = table.join(reps, "digest", "left")
    return per_row.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of each component the one with the smallest id; ids are taken as unique here."""
    gone = materialize(near_components(docs, id_col, text_col, words, percent).filter("id != component_id").select(F.col("id").alias(id_col)).distinct())
    return docs.filter(F.col(id_col).isNotNull()).join(small(gone), id_col, "left_anti")
