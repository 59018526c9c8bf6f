"""Static binary-fuse filters (three-wise, 8-bit fingerprints) over 64-bit keys, built and asked in whole numpy arrays.

A filter takes about nine bits a key, never misses a stored key and lets about one foreign key in 256 through.
"""

from __future__ import annotations

import math

import numpy as np

MAX_SEEDS = 100


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of start segments."""
    length = 1 << min(18, max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    return length, max(1, math.ceil(room / length) - 2)


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three cells for each key, in three neighbouring segments."""
    mask = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(length * segments)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _marks(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def _peeling(places: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell that each key has for itself when its turn comes); None if some keys can't be freed."""
    n = places.shape[1]
    load = np.bincount(places.ravel(), minlength=cells)
    held = np.zeros(cells, dtype=np.int64)
    for row in places:
        np.bitwise_xor.at(held, row, np.arange(n))
    rounds, freed, single = [], 0, np.flatnonzero(load == 1)
    while len(single):
        keys, at = np.unique(held[single], return_index=True)
        rounds.append((keys, single[at]))
        freed += len(keys)
        for row in places[:, keys]:
            np.subtract.at(load, row, 1)
            np.bitwise_xor.at(held, row, keys)
        touched = np.unique(places[:, keys].ravel())
        single = touched[load[touched] == 1]
    return rounds if freed == n else None


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, start segments and fingerprints of a set of keys."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(MAX_SEEDS):
        h = _mixed(keys, seed)
        places = _places(h, length, segments)
        rounds = _peeling(places, length * (segments + 2))
        if rounds is None:
            continue
        cells, marks = np.zeros(length * (segments + 2), dtype=np.uint8), _marks(h)
        for own, cell in reversed(rounds):
            a, b, c = places[:, own]
            cells[cell] = marks[own] ^ cells[a] ^ cells[b] ^ cells[c]
        return seed, length, segments, cells.tobytes()
    raise RuntimeError(f"no binary-fuse filter over {len(keys)} keys after {MAX_SEEDS} seeds")


def contains(made: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, length, segments, raw = made
    h = _mixed(keys.astype(np.uint64), seed)
    a, b, c = _places(h, length, segments)
    cells = np.frombuffer(raw, dtype=np.uint8)
    return _marks(h) == cells[a] ^ cells[b] ^ cells[c]
