"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are counted in words (or by a given tokenizer) and cut into pieces no longer than the largest length.  Pieces are dealt evenly by
hash into groups of about ``GROUP`` pieces; each group is packed on its own, so groups are of like size whatever the source, and the
loss against one large group is at most the half-filled bins at its end.

Packing takes pieces from long to short and puts each into the open bin that it fills best.  If none has room a new bin is
opened: of the permitted lengths that hold the piece, the one with the least cost per token that it can still be filled
with.  How far lengths above the smallest fitting one are worth opening depends on what else is there to fill them, so the group is packed once for
each largest opening length, all plans are costed after every bin has been downsized to the smallest length that holds its
contents, and the cheapest plan stays.

The cost of a sequence of length c is c plus ``overhead`` tokens.

Edge cases: null and empty texts have no tokens and no pieces; a text longer than the largest length gives several pieces; ties go by id
and piece; rows that repeat are packed as often as they stand; an empty table gives an empty result; other columns are kept
out of the plan.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, shard_count, text_batches

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 8
#: Pieces packed together.
GROUP = 20_000

_WORD = re.compile(r"\S+")


def word_ends(text: str) -> np.ndarray:
    """Where each word of the text ends, in characters."""
    return np.fromiter((m.end() for m in _WORD.finditer(text)), dtype=np.int64)


def cut(text: str | None, most: int, ends: Callable[[str], np.ndarray] = word_ends) -> list[tuple[int, int, int, int]]:
    """(piece, tokens, first character, last character + 1) of a text in pieces of at most ``most`` tokens."""
    if not text:
        return []
    n = len(text.split()) if ends is word_ends else None
    if n is not None and n <= most:
        return [(0, n, 0, len(text))] if n else []
    at = ends(text)
    out, start = [], 0
    for piece, first in enumerate(range(0, len(at), most)):
        last = min(first + most, len(at))
        stop = len(text) if last == len(at) else int(at[last - 1])
        out.append((piece, last - first, start, stop))
        start = stop
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LENGTHS[-1], ends: Callable[[str], np.ndarray] = word_ends) -> DataFrame:
    """id, piece, tokens, char_start, char_end of every piece of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece", "tokens", "char_start", "char_end"]
        for batch in batches:
            made = [(k, *p) for k, text in enumerate(batch.column(1).to_pylist()) for p in cut(text, most, ends)]
            ids = batch.column(0).take(pa.array([m[0] for m in made], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[j] for m in made], pa.int64()) for j in range(1, 5))], names=names)

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, piece long, tokens long, char_start long, char_end long"))


def _open_length(size: int, left: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The length with the least cost per token that can still be put into it; the shortest of equals."""
    return min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, max(size, left)), c))


def _plan(sizes: list[int], lengths: tuple[int, ...], opened: int, overhead: int) -> list[int]:
    """Bin number of each piece; sizes fall.  No bin longer than ``opened`` is opened for a piece that a shorter one holds."""
    left, out, room, bins = sum(sizes), [], [], {}
    count = 0
    for size in sizes:
        k = bisect.bisect_left(room, size)
        if k < len(room):
            free = room[k]
            held = bins[free]
            number = held.pop()
            if not held:
                del bins[free]
                room.pop(k)
        else:
            allowed = tuple(c for c in lengths if c <= opened) if size <= opened else lengths
            free, number = _open_length(size, left, allowed, overhead), count
            count += 1
        free -= size
        left -= size
        if free:
            if free not in bins:
                bins[free] = []
                bisect.insort(room, free)
            bins[free].append(number)
        out.append(number)
    return out


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each piece, and length of each bin, of the cheapest plan; sizes must fall and be positive."""
    best = None
    for opened in lengths:
        bins = _plan(sizes, lengths, opened, overhead)
        filled = np.bincount(bins, weights=sizes).astype(np.int64) if bins else np.zeros(0, dtype=np.int64)
        length = np.asarray(lengths)[np.searchsorted(lengths, filled)]
        cost = int(length.sum()) + overhead * len(length)
        if best is None or cost < best[0]:
            best = cost, bins, length.tolist()
    return best[1], best[2]


def packed(parts: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """The pieces with their place: group_no, bin, position in the bin, first token in the sequence, and the sequence's length and fill."""
    lengths = tuple(sorted(lengths))
    salt = free_name(parts, "salt")
    parts = materialize(parts.withColumn(salt, F.monotonically_increasing_id()))  # tells rows of equal id and piece apart
    groups = shard_count(parts.count(), group)

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(["tokens", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, length = pack(one["tokens"].tolist(), lengths, overhead)
        one["bin"] = bins
        before = one.groupby("bin")["tokens"].cumsum() - one["tokens"]
        one["position"], one["token_start"] = one.groupby("bin").cumcount(), before
        one["length"] = np.asarray(length, dtype=np.int64)[one["bin"]] if len(one) else one["bin"]
        one["filled"] = one.groupby("bin")["tokens"].transform("sum")
        return one

    kind = parts.schema["id"].dataType.simpleString()
    return (parts.withColumn("group_no", F.pmod(F.xxhash64("id", "piece", salt), F.lit(groups))).drop(salt).groupBy("group_no")
            .applyInPandas(run, f"id {kind}, piece long, tokens long, char_start long, char_end long, group_no long, bin long, position long, token_start long, length long, filled long"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    return packed(pieces(docs, id_col, text_col, max(lengths)), lengths)


def sequences(plan: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", between: str = "\n\n") -> DataFrame:
    """group_no, bin, length, filled and the text of each sequence: its pieces in order; ids are taken as unique here."""
    body = plan.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "id")
    piece = F.substring("_text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    return (body.groupBy("group_no", "bin", "length", "filled").agg(F.sort_array(F.collect_list(F.struct("position", piece.alias("t")))).alias("p"))
            .select("group_no", "bin", "length", "filled", F.array_join(F.transform("p", lambda x: x["t"]), between).alias("text")))
