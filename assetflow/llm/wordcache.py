"""Ids of words that a task has encoded already, by one tokenizer or by several at once."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np

REMEMBERED_WORDS, REMEMBERED_CHARS = 500_000, 16 << 20


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs ``starts[i]``, ``starts[i] + 1``, ... of ``sizes[i]`` each, in order."""
    after = np.cumsum(sizes)
    return np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)


class Remembered:
    """Word -> its ids by each encoder; forgets all when it holds too much."""

    def __init__(self, *encoders: Callable[[list[str]], Iterable[list[int]]]):
        self._encoders = encoders
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._chars = 0
        self._ids = [array("I") for _ in self._encoders]
        self._ends = [array("q", [0]) for _ in self._encoders]

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Where each word is kept; good until the next call."""
        if len(self._rows) > REMEMBERED_WORDS or self._chars > REMEMBERED_CHARS:
            self._forget()
        rows = self._rows
        unseen = [w for w in words if w not in rows]
        for word in unseen:
            rows[word] = len(rows)
            self._chars += len(word)
        for encode, ids, ends in zip(self._encoders, self._ids, self._ends, strict=True):
            for found in encode(unseen):
                ids.extend(found)
                ends.append(len(ids))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def ids_of(self, rows: np.ndarray, encoder: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, ids of all)."""
        ids, ends = (np.array(x[encoder], copy=True) for x in (self._ids, self._ends))
        sizes = ends[rows + 1] - ends[rows]
        return sizes, ids[runs(ends[rows], sizes)]
