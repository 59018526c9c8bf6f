"""Sorted runs in blocks, and their merge by a loser tree.

A block is a slice of a sorted run: its first and last key and its rows as one compressed Arrow body.  ``merge`` reads blocks in the order of
their first keys, keeps open those that overlap, and gives rows away as soon as no later block can come before them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

#: Rows of a block, and rows that a merge opens at once.
BLOCK, OPEN = 2048, 65_536


class LoserTree:
    """The smallest of k sorted sources, replayed along one path after each step: every inner node remembers the loser of its match."""

    def __init__(self, sources: list[list]):
        self.sources, self.at, self.k = sources, [0] * len(sources), len(sources)
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether source a's next row comes first; used-up sources come last, ties by number."""
        x, y = self.sources[a], self.sources[b]
        if self.at[b] >= len(y):
            return True if self.at[a] < len(x) else a < b
        if self.at[a] >= len(x):
            return False
        return (x[self.at[a]], a) < (y[self.at[b]], b)

    def _play(self, leaf: int, building: bool = False) -> None:
        node, held = (leaf + self.k) // 2, leaf
        while node:
            other = self.losers[node]
            if building and other < 0:  # the first to come waits for its match
                self.losers[node] = held
                return
            if other >= 0 and self._before(other, held):
                self.losers[node], held = held, other
            node //= 2
        self.winner = held

    def peek(self):
        """Key of the next row, or None."""
        w = self.winner
        return self.sources[w][self.at[w]] if w >= 0 and self.at[w] < len(self.sources[w]) else None

    def pop(self) -> tuple[int, int]:
        """Source and place of the next row."""
        w = self.winner
        place = self.at[w]
        self.at[w] += 1
        self._play(w)
        return w, place


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def keys_of(rows: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*(rows[n].to_pylist() for n in names)))


def cut(rows: pa.RecordBatch, keys: list[tuple], fences: list[tuple]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Range number and rows of a sorted slice between fences; range k lies before fence k."""
    at, k = 0, bisect_left(fences, keys[0])
    while at < len(keys):
        while k < len(fences) and fences[k] <= keys[at]:
            k += 1
        end = bisect_left(keys, fences[k], at) if k < len(fences) else len(keys)
        yield k, rows.slice(at, end - at)
        at = end


def quantile_fences(points: list[tuple], ranges: int) -> list[tuple]:
    """Keys that cut a sample into ranges of about equal size."""
    points = sorted(points)
    fences = []
    for k in range(1, ranges):
        point = points[k * len(points) // ranges] if points else None
        if point is not None and (not fences or fences[-1] < point):
            fences.append(point)
    return fences


def merge(blocks: Iterator[pa.RecordBatch], names: list[str], most: int = OPEN) -> Iterator[pa.RecordBatch]:
    """All rows in key order, from slices of sorted runs that come in the order of their first keys."""
    held: list[tuple[pa.RecordBatch, list[tuple]]] = []
    rows, following = 0, next(blocks, None)
    while following is not None or held:
        while following is not None and rows < most:
            held.append((following, keys_of(following, names)))
            rows += following.num_rows
            following = next(blocks, None)
        bound = keys_of(following.slice(0, 1), names)[0] if following is not None else None
        tree, order = LoserTree([keys for _, keys in held]), []
        starts = [0]
        for batch, _ in held:
            starts.append(starts[-1] + batch.num_rows)
        while (key := tree.peek()) is not None and (bound is None or key < bound):
            source, place = tree.pop()
            order.append(starts[source] + place)
        if order:
            yield pa.Table.from_batches([b for b, _ in held]).take(pa.array(order)).combine_chunks().to_batches()[0]
        held = [(b.slice(tree.at[k]), keys[tree.at[k]:]) for k, (b, keys) in enumerate(held) if tree.at[k] < b.num_rows]
        before, rows = rows, sum(b.num_rows for b, _ in held)
        if rows >= most:  # blocks that all overlap: open more of them before the next try
            most = 2 * rows
