"""Words of texts and their character n-grams as numpy arrays, and rows of numbers kept per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that belong to words of a lower-cased UTF-8 text; the others become blanks.
LETTER_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOKEN_BYTES = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def lowered(text: str | None, table: bytes) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(table).split() if text else []


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(words: list[bytes], orders: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order n: n, the word of each n-gram, its first place among all letters and its 64-bit hash.

    Words stand between ``<`` and ``>``, so an n-gram knows whether it begins or ends a word.
    """
    texts = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    for n in orders:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = _stir(h * np.uint64(0xD6E8FEB86659FD93) + letters[at + k])
        yield n, owner[at], at, h


class WordRows(dict):
    """Row numbers of words in a matrix: known words first, unseen ones as they come, their rows worked out many at a time.

    At most ``room`` unseen words are remembered between two calls.
    """

    def __init__(self, known: dict[bytes, int], matrix: np.ndarray, unseen: Callable[[list[bytes]], np.ndarray], room: int = 150_000):
        super().__init__(known)
        self.known, self.base, self.matrix, self.unseen, self.room, self.new = known, matrix, matrix, unseen, room, []

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def numbers(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the words of each document; ``matrix`` holds them until the next call."""
        if len(self) > len(self.known) + self.room:
            self.clear()
            self.update(self.known)
            self.matrix = self.base
        out = [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)) for words in docs]
        if self.new:
            self.matrix = np.concatenate([self.matrix, self.unseen(self.new).astype(self.base.dtype)])
            self.new = []
        return out


def by_size(rows: Iterator, size: Callable[..., int], most: int) -> Iterator[list]:
    """Runs of rows whose sizes add up to ``most`` or a little more; a larger single row is a run of its own."""
    run, held = [], 0
    for row in rows:
        run.append(row)
        held += size(row)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run
