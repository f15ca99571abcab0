"""Words of many texts at once, and rolling hashes of any run of bytes or words, in numpy.

A hash of a run is the difference of two prefix sums of value * base**position, divided by
base**start; all modulo 2**64, where an odd base has an inverse. So one pass over the bytes
gives the hash of every word and line, and one pass over the words that of every n-gram.
"""

from __future__ import annotations

import numpy as np

_BYTE_BASE = 0x9DDFEA08EB382D69
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse, grown when a longer run is needed."""

    def __init__(self, base: int):
        self._base = (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        self._tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            made = []
            for base in self._base:
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self._tables = tuple(made)
        return self._tables[0][:n], self._tables[1][:n]


class Hasher:
    """Keeps the tables of powers between the batches of a task."""

    def __init__(self):
        self._bytes, self._words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)

    def words(self, texts: list[bytes | None]) -> Words:
        return Words(self, texts)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """Runs of bytes other than \\x20 and \\x09-\\x0D in each text.

    ``start``, ``end``: bytes of a word in ``data``; ``first[i]`` to ``first[i + 1]``: the
    words of text i; ``doc``: the text a word is in; ``hash``: of the word's bytes.
    """

    def __init__(self, hasher: Hasher, texts: list[bytes | None]):
        self._hasher = hasher
        parts = [t or b"" for t in texts]
        self.data = np.frombuffer(b" ".join([*parts, b""]) or b" ", np.uint8)
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        self.text_start = _sums(sizes + 1)[:-1]
        self.text_end = self.text_start + sizes
        space = _SPACE[self.data]
        inside = ~space
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, [*self.text_start, len(self.data)])
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self._space = space
        power, self._inverse = hasher._bytes.get(len(self.data) + 1)
        self._prefix = _sums((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1])
        self.hash = self.hash_bytes(self.start, self.end)
        self._word_prefix = None

    def hash_bytes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run of bytes."""
        value = (self._prefix[end] - self._prefix[start]) * self._inverse[start]
        return mix(value + (end - start).astype(np.uint64))

    def hash_ngrams(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on; the last n - 1 places have none."""
        power, inverse = self._hasher._words.get(len(self.hash) + 1)
        if self._word_prefix is None:
            self._word_prefix = _sums(self.hash * power[: len(self.hash)])
        many = max(0, len(self.hash) - n + 1)
        run = self._word_prefix[n : n + many] - self._word_prefix[:many]
        return mix(run * inverse[:many] + np.uint64(n))

    def code_points(self) -> np.ndarray:
        """Prefix counts of code points over ``data``, the spaces between texts included."""
        return _sums(((self.data & 0xC0) != 0x80).astype(np.int64))

    def by_text(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a number per word over each text."""
        total = _sums(per_word.astype(np.int64))
        return total[self.first[1:]] - total[self.first[:-1]]
